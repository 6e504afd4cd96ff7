"""Spans of decisions in texts: an exact merge of neighbours, and the grounding of quotes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.mapped import check_mentions
from docmill.functions.text import tokens
from docmill.sources.tables import table


@dataclass(frozen=True)
class MergeRules:
    """When two neighbouring spans are one. The words are fixed values: connectors that begin a decision of its own, and the word that
    heads one."""

    overlap: float = 0.85
    separator: int = 60
    connectors: tuple[str, ...] = ("כמו כן", "וכן", "בנוסף")
    heading: str = "החלטה"

    def separates(self, between: str) -> bool:
        plain = regex.sub(r"\s+", " ", between)
        return not 0 < len(between) <= self.separator or "\n" in between or "." in between or self.heading in between or any(c in plain for c in self.connectors)

    def same(self, left: str, right: str) -> bool:
        """Whether overlapping texts say the same: one's words hold the other's, and no connector begins another decision."""
        a, b = signature(left), signature(right)
        return bool(a and b) and (a in b or b in a) and not any(c in right for c in self.connectors)


def signature(text: str) -> str:
    return regex.sub(r"\s+", " ", regex.sub(r"[^\p{L}\p{N}_\s]", " ", text.lower())).strip()[:255]


def fold_spans(text: str, spans: list, rules: MergeRules) -> Iterator[list]:
    """[start, end, number, confidence, parts] of the merged spans of a text."""
    ordered = sorted((s["start"], s["end"], i) for i, s in enumerate(spans) if s and s["start"] is not None and s["end"] is not None and 0 <= s["start"] < s["end"] <= len(text))
    now: list | None = None
    for start, end, i in ordered:
        s = spans[i]
        if now is not None:
            if start <= now[1]:
                shared = min(now[1], end) - start
                joins = shared > 0 and shared / max(min(now[1] - now[0], end - start), 1) >= rules.overlap and rules.same(text[now[0] : now[1]], text[start:end])
            else:
                joins = not rules.separates(text[now[1] : start])
            if joins:
                now = [now[0], max(now[1], end), now[2] or s["number"], max(now[3], s["confidence"] or 0.0), now[4] + 1]
                continue
            yield now
        now = [start, end, s["number"], s["confidence"] or 0.0, 1]
    if now is not None:
        yield now


SPAN = "struct<start: int, end: int, number: string, confidence: double>"


def merge_spans(docs: DataFrame, rules: MergeRules = MergeRules()) -> DataFrame:
    """(doc_id, start, end, number, confidence, parts) of docs (doc_id, text, spans: array of start, end, number, confidence).

    A fold over each text's spans in order of (start, end), whose state is the merged predecessor: a span that begins inside it joins
    if they share `overlap` of the shorter one and one's words hold the other's; a later one joins if a short separator without a
    break stands between. A merged span takes the first number and the highest confidence. Spans outside the text, null texts and
    null lists have no result; repeated rows are folded each for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if text is not None and spans:
                    out += [(doc, *x) for x in fold_spans(text, spans, rules)]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["doc_id", "start", "end", "number", "confidence", "parts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("spans").cast(f"array<{SPAN}>").alias("spans")).mapInArrow(run, "doc_id long, start int, end int, number string, confidence double, parts int")


def _pieces(text: str, marks: str, least: int) -> str:
    """Spark SQL for the stretches between marks with `least` characters or more, as spans of the text."""
    cut = f"split({text}, '{marks}', -1)"
    starts = f"transform({cut}, (x, i) -> struct(aggregate(slice({cut}, 1, i), 0, (s, y) -> s + length(y) + 1) AS start, x))"
    return f"transform(filter({starts}, p -> length(p.x) >= {least}), p -> struct(p.start AS start, p.start + length(p.x) AS end, nullif(regexp_extract(p.x, '([0-9]+)', 1), '') AS number, CASE WHEN length(p.x) >= 40 THEN 0.9D ELSE 0.7D END AS confidence))"


def merged_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each conversation turn of 40 characters or more and the pieces of its sentences of 12 or more, merged."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    spans = F.concat(F.expr(_pieces("text", "\\\\n", 40)), F.expr(_pieces("text", "[,.\\\\n]", 12)))
    merged = merge_spans(turns.withColumn("spans", spans))
    return merged.select("doc_id", F.col("start").cast("long").alias("start_"), F.col("end").cast("long").alias("end_"), F.coalesce("number", F.lit("")).alias("number"), "confidence", F.col("parts").cast("long").alias("parts"))


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}_]+", text)]


def covered(span: str, quote: str) -> float:
    """The share of the span's different words that the quote has."""
    a, b = {w for w, *_ in _words(span)}, {w for w, *_ in _words(quote)}
    return len(a & b) / len(a) if a and b else 0.0


def align(quote: list[str], words: list[str]) -> tuple[int, int, int]:
    """(first, last + 1, edits) of the stretch of words that is nearest to the quote by insertions, deletions and changes of words; of
    equal ones the first that ends."""
    codes: dict[str, int] = {}
    q, w = (np.array([codes.setdefault(x, len(codes)) for x in side], np.int64) for side in (quote, words))
    n = len(w)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    at = np.arange(n + 1)
    for i, x in enumerate(q):
        change, deletion = cost[:-1] + (w != x), cost[1:] + 1
        best = np.concatenate(([i + 1], np.minimum(change, deletion)))
        origin = np.concatenate(([0], np.where(change <= deletion, start[:-1], start[1:])))
        # an insertion costs one for each word passed: the running least of cost - place
        run = np.minimum.accumulate(best - at)
        new = np.concatenate(([True], run[1:] < run[:-1]))
        source = np.maximum.accumulate(np.where(new, at, 0))
        cost, start = run + at, origin[source]
    end = int(cost.argmin())
    return int(start[end]), end, int(cost[end])


SENTENCE_MARKS = ".!?"


def sentence_end(text: str, end: int, most: int = 400) -> int:
    """Where the sentence around `end` is over: behind its mark, before a ruled line, or after `most` characters."""
    found = regex.compile(r"[.!?]|(?=_{16})").search(text, end, min(len(text), end + most))
    return len(text[: found.end() if found else min(len(text), end + most)].rstrip())


def sentence_start(text: str, start: int, most: int = 160) -> int:
    marks = [m.end() for m in regex.finditer(r"[\n.:;!?]", text[max(0, start - most) : start])]
    begin = max(0, start - most) + (marks[-1] if marks else 0)
    return begin + len(text[begin:]) - len(text[begin:].lstrip())


def inside_word(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


def ground(text: str, quote: str | None, window: tuple[int, int], offsets: tuple[int | None, int | None], near: int = 600, fuzzy: float = 0.7, trusted: float = 0.8) -> tuple[int | None, int | None, str]:
    """(start, end, how): exact or fuzzy if the quote, or words like it, stand within `near` characters of the window; offset if the
    given offsets hold such words; otherwise (None, None, reason)."""
    wanted = (quote or "").strip()
    if not wanted:
        return None, None, "missing_text"
    low, high = max(0, window[0] - near), min(len(text), window[1] + near)
    how, span = "", (0, 0)
    if (found := text.find(wanted, low, high)) >= 0:
        how, span = "exact", (found, found + len(wanted))
    elif (words := _words(text[low:high])) and (asked := [w for w, *_ in _words(wanted)]):
        first, last, _ = align(asked, [w for w, *_ in words])
        if first < last and covered(text[low + words[first][1] : low + words[last - 1][2]], wanted) >= fuzzy:
            how, span = "fuzzy", (low + words[first][1], low + words[last - 1][2])
    if not how:
        start, end = offsets
        if start is None or end is None or not 0 <= start < end <= len(text):
            return None, None, "span_unresolved"
        how, span = "offset", (start, end)
    start, end = span
    if how == "offset" or inside_word(text, start) or inside_word(text, end):
        start, end = min(start, sentence_start(text, start)), max(end, sentence_end(text, end))
    if start >= end or not text[start:end].strip():
        return None, None, "empty_span"
    # a clause that goes on behind the span belongs to it
    tail = regex.match(r"[^\S\n]{0,23}[,;:]", text[end : end + 24])
    if text[start:end].rstrip()[-1] not in SENTENCE_MARKS and tail:
        end = max(end, sentence_end(text, end))
    if how == "offset":
        if covered(text[start:end], wanted) < trusted:
            return None, None, "offset_mismatch"
        if inside_word(text, start) or inside_word(text, end):
            return None, None, "offset_midword"
    return start, end, how


def ground_quotes(rows: DataFrame) -> DataFrame:
    """(id, start, end, how, span) of rows (id, text, quote, low, high, start, end): where each quote stands in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text = r["text"] or ""
                start, end, how = ground(text, r["quote"], (r["low"] or 0, r["high"] if r["high"] is not None else len(text)), (r["start"], r["end"]))
                out.append((r["id"], start, end, how, None if start is None else text[start:end]))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["id", "start", "end", "how", "span"])

    named = rows.select(F.col("id").cast("long").alias("id"), "text", "quote", *[F.col(c).cast("int").alias(c) for c in ("low", "high", "start", "end")])
    return named.mapInArrow(run, "id long, start int, end int, how string, span string")


def quote_grounding(spark: SparkSession, d: str) -> DataFrame:
    """A quote of each document of 200 characters or more: as it is, with eight characters cut out, in capitals, far from its window
    with true offsets, or of other words."""
    docs = table(spark, d, "documents").where("length(text) >= 200")
    docs = docs.select("doc_id", "text", F.expr("CAST(pmod(doc_id * 37, length(text) - 150) AS INT)").alias("p"), F.expr("pmod(doc_id, 5)").alias("kind"))
    docs = docs.withColumn("part", F.expr("substr(text, p + 1, 120)"))
    quote = F.expr("CASE kind WHEN 1 THEN concat(substr(part, 1, 56), substr(part, 65)) WHEN 2 THEN upper(part) WHEN 4 THEN 'qq ww ee rr tt yy' ELSE part END")
    far = F.expr("kind = 3 AND p > 900")
    low = F.when(far, F.lit(0)).otherwise(F.col("p"))
    rows = docs.select(F.col("doc_id").alias("id"), "text", quote.alias("quote"), low.alias("low"), (low + F.when(far, F.lit(10)).otherwise(120)).alias("high"), F.when(F.col("kind") >= 3, F.col("p")).alias("start"), F.when(F.col("kind") >= 3, F.col("p") + 120).alias("end"))
    found = ground_quotes(rows)
    return found.select(F.col("id").alias("doc_id"), F.coalesce("start", F.lit(-1)).alias("start_"), F.coalesce("end", F.lit(-1)).alias("end_"), "how", F.md5(F.coalesce("span", F.lit(""))).alias("span_md5"))


def mention_checks(spark: SparkSession, d: str) -> DataFrame:
    """The commonest word of four letters or more of each language, in capitals, as a mention in its documents: claimed where it first
    stands, three characters further, or beyond the end, as the document's id says."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    words = docs.select("lang", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).where("length(term) >= 4")
    top = words.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.min_by("term", F.struct(-F.col("n"), "term")).alias("term"))
    place = F.instr(F.lower("text"), F.col("term")) - 1
    start = F.expr("CASE pmod(doc_id, 3) WHEN 0 THEN place WHEN 1 THEN place + 3 ELSE length(text) + 5 END")
    rows = docs.join(F.broadcast(top), "lang").withColumn("place", place).select(F.col("doc_id").alias("id"), "text", F.upper("term").alias("mention"), start.alias("start"), (start + F.length("term")).alias("end"))
    found = check_mentions(rows)
    return found.select(F.col("id").alias("doc_id"), "verdict", F.coalesce("found_start", F.lit(-1)).alias("found_start"), F.coalesce("found_end", F.lit(-1)).alias("found_end"))


QUERIES = {f.__name__: f for f in (merged_lines, quote_grounding, mention_checks)}
_DUCK = "(SELECT doc_id, text, p AS start_, p + length(x) AS end_, coalesce(nullif(regexp_extract(x, '([0-9]+)', 1), ''), '') AS number, CASE WHEN length(x) >= 40 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence, {1} AS source, i FROM (SELECT doc_id, text, x, i, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p FROM (SELECT doc_id, text, unnest(string_split_regex(text, '{0}')) AS x, unnest(range(len(string_split_regex(text, '{0}')))) AS i FROM t)) WHERE length(x) >= {2})"
_SIG = "left(trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 255)"
_A, _B = _SIG.format("substr(n.text, r.start_ + 1, r.end_ - r.start_)"), _SIG.format("substr(n.text, n.start_ + 1, n.end_ - n.start_)")
ORACLE_SQL = {
    # the fold as a recursion over the spans of each text; g counts the merged ones
    "merged_lines": f"""
WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations), s AS (SELECT * FROM {_DUCK.format(chr(92) + "n", 0, 40)} UNION ALL SELECT * FROM {_DUCK.format("[,." + chr(92) + "n]", 1, 12)}),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_, end_, source, i) AS k FROM s),
r AS (SELECT doc_id, k, start_, end_, number, confidence, 1::BIGINT AS parts, 1 AS g FROM n WHERE k = 1
UNION ALL SELECT doc_id, k, CASE WHEN j THEN a ELSE start_ END, CASE WHEN j THEN greatest(b, end_) ELSE end_ END, CASE WHEN j AND m <> '' THEN m ELSE number END, CASE WHEN j THEN greatest(c, confidence) ELSE confidence END, CASE WHEN j THEN parts + 1 ELSE 1 END, CASE WHEN j THEN g ELSE g + 1 END
FROM (SELECT n.doc_id, n.k, n.start_, n.end_, n.number, n.confidence, r.start_ AS a, r.end_ AS b, r.number AS m, r.confidence AS c, r.parts, r.g,
  CASE WHEN n.start_ <= r.end_ THEN least(r.end_, n.end_) > n.start_ AND (least(r.end_, n.end_) - n.start_) / greatest(least(r.end_ - r.start_, n.end_ - n.start_), 1) >= 0.85 AND {_A} <> '' AND {_B} <> '' AND (contains({_A}, {_B}) OR contains({_B}, {_A}))
  ELSE n.start_ - r.end_ <= 60 AND NOT regexp_matches(substr(n.text, r.end_ + 1, n.start_ - r.end_), '[.\\n]') END AS j FROM r JOIN n ON n.doc_id = r.doc_id AND n.k = r.k + 1))
SELECT doc_id, start_, end_, number, confidence, parts FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY k DESC) = 1""",
    # of these texts only the case differs between a mention and its place
    "mention_checks": """
WITH c AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS term FROM documents) WHERE length(term) >= 4 GROUP BY 1, 2),
t AS (SELECT lang, term FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) = 1),
p AS (SELECT doc_id, text, term, instr(lower(text), term) - 1 AS place, length(text) AS n, length(term) AS k FROM documents JOIN t USING (lang)),
s AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN place WHEN 1 THEN place + 3 ELSE n + 5 END AS start_ FROM p), r AS (SELECT *, start_ >= 0 AND start_ + k <= n AS inside FROM s),
v AS (SELECT *, CASE WHEN inside AND substr(text, start_ + 1, k) = upper(term) THEN 'strict' WHEN inside AND lower(substr(text, start_ + 1, k)) = term THEN 'normalised' WHEN place >= 0 THEN 'moved' WHEN inside THEN 'mismatch' ELSE 'out_of_range' END AS verdict FROM r)
SELECT doc_id, verdict, CASE WHEN verdict IN ('strict', 'normalised') THEN start_ WHEN verdict = 'moved' THEN place ELSE -1 END AS found_start, CASE WHEN verdict IN ('strict', 'normalised') THEN start_ + k WHEN verdict = 'moved' THEN place + k ELSE -1 END AS found_end FROM v""",
}
