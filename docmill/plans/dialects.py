"""One statement in two dialects: Spark SQL, and DuckDB for the comparison."""

from __future__ import annotations

import re

#: placeholder: (Spark, DuckDB)
NAMES = {
    "LEN(": ("size(", "len("), "AINT(": ("array_intersect(", "list_intersect("), "ADIS(": ("array_distinct(", "list_distinct("), "ACAT(": ("concat(", "list_concat("),
    "AHAS(": ("array_contains(", "list_contains("), "FILT(": ("filter(", "list_filter("), "MAPL(": ("transform(", "list_transform("), "EXPLODE(": ("explode(", "unnest("),
    "AJOIN(": ("array_join(", "array_to_string("), "ASORT(": ("array_sort(", "list_sort("), "LISTOF(": ("collect_list(", "list("), "SPLIT(": ("split(", "string_split("),
    "SEQ(": ("sequence(", "generate_series("), "AT(": ("try_element_at(", "list_extract("), "HEAD(": ("slice(", "list_slice("), "HAS(": ("rlike(", "regexp_matches("),
    "STARTS(": ("startswith(", "starts_with("), "ENDS(": ("endswith(", "ends_with("), "JSONGET(": ("get_json_object(", "json_extract_string("),
    ", ALL)": (", 1)", ", 'g')"), " STRING)": (" STRING)", " VARCHAR)"), "CENTRE": ("transform(array_sort(collect_list(struct(pos, x))), p -> p.x)", "list(x ORDER BY pos)"), "NEWLINE": ("'\\n'", "chr(10)"),
}


_SPARK_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, v) -> s + v)"
_SPARK_COSINE = f"({_SPARK_DOT.format(chr(92) + '1', chr(92) + '2')} / nullif(sqrt({_SPARK_DOT.format(chr(92) + '1', chr(92) + '1')}) * sqrt({_SPARK_DOT.format(chr(92) + '2', chr(92) + '2')}), 0D))"


def both(statement: str) -> tuple[str, str]:
    """Placeholders in upper case, x => for lambdas, #1.5 for doubles, R'' for patterns, W(x) for words, SHA(x), COS(x; y) of vectors, POSEX(a; pos, v), AGGTEXT(v; pos)."""
    out = []
    for k in (0, 1):
        s = re.sub(r"\bW\(([\w.]+)\)", r"regexp_extract_all(lower(\1), R'([\\p{L}\\p{N}]+)', 1)", statement)
        s = re.sub(r"\bSHA\(([^()]+)\)", (r"sha2(\1, 256)", r"sha256(\1)")[k], s)
        s = re.sub(r"\bPOSEX\(([^;]*); (\w+), (\w+)\)", (r"posexplode(\1) AS (\2, \3)", r"unnest(range(len(\1))) AS \2, unnest(\1) AS \3")[k], s)
        s = re.sub(r"\bAGGTEXT\(([^;]*); ([^()]*)\)", (r"listagg(\1, ',') WITHIN GROUP (ORDER BY \2)", r"string_agg(\1, ',' ORDER BY \2)")[k], s)
        s = re.sub(r"\bCOS\(([\w.]+); ([\w.]+)\)", (_SPARK_COSINE, r"list_cosine_similarity(CAST(\1 AS DOUBLE[]), CAST(\2 AS DOUBLE[]))")[k], s)
        s = re.sub(r"(\w+) => ", (r"\1 -> ", r"lambda \1: ")[k], s)
        s = re.sub(r"#(\d*\.?\d+)", (r"\1D", r"\1::DOUBLE")[k], s)
        s = re.sub(r"\bR'", ("r'", "'")[k], s)
        for name, texts in NAMES.items():
            s = re.sub((r"\b" if name[0].isalpha() else "") + re.escape(name), lambda _, t=texts[k]: t, s)
        out.append(s)
    return out[0], out[1]
