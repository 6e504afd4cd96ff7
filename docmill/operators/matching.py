"""Joins by likeness that are complete: near vectors, ids within a few edits, aliases, and one-to-one matches."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.functions.text import trigrams
from docmill.operators.search import _units
from docmill.plans.dialects import both
from docmill.operators.relational import run_statement
from docmill.sources.tables import lasting, table

#: Vectors of a tile: a task multiplies two tiles of one group, so many rows of the first at a time.
TILE, AT_ONCE = 4096, 512
#: Vectors of a group that one step of the pass settles; up to 1000 Spark limits them before it shuffles.
HEAD = 1000
#: Near pairs for each vector that are written.
FEW = 16


def _by_size(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors their rows in t, and the unit vectors."""
    found: dict[int, tuple[list, list]] = {}
    for i, x in enumerate(t.column("embedding").to_pylist()):
        if x and None not in x:
            at, rows = found.setdefault(len(x), ([], []))
            at.append(i)
            rows.append(x)
    return {n: (np.array(at), _units(np.array(rows, float))) for n, (at, rows) in found.items()}


def _near_in_tiles(threshold: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, s = [], [], []
        if left.num_rows and right.num_rows:
            ids = [t.column("id").to_numpy() for t in (left, right)]
            sides = [_by_size(t) for t in (left, right)]
            one = left.column("lo")[0] == left.column("hi")[0]
            for n in sides[0].keys() & sides[1].keys():
                (x, u), (y, v) = ((i[at], w) for i, (at, w) in zip(ids, (side[n] for side in sides)))
                for k in range(0, len(x), AT_ONCE):
                    near = np.round(u[k : k + AT_ONCE] @ v.T, 6)
                    i, j = np.nonzero(near >= threshold)
                    p, q = x[k + i], y[j]
                    keep = p < q if one else p != q
                    a.append(p[keep]), b.append(q[keep]), s.append(near[i, j][keep])
        whole = lambda parts, t: pa.array(np.concatenate(parts) if parts else np.zeros(0), t)
        return pa.table([whole(a, pa.int64()), whole(b, pa.int64()), whole(s, pa.float64())], names=["a", "b", "similarity"])

    return run


def near_pairs(v: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs of v (id, grp, embedding; distinct ids) of one group whose cosine is threshold or more.

    A group is dealt into tiles of about TILE vectors by hash, and each two tiles of it are a task of one matrix product: a large
    group spreads over many tasks, and only near pairs leave them. Null, empty and zero vectors are near nothing.
    """
    tiles = v.groupBy(F.col("grp").alias("g")).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    dealt = v.join(tiles, F.col("grp").eqNullSafe(F.col("g"))).drop("g").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    left = dealt.withColumn("lo", F.col("tile")).withColumn("hi", F.explode(F.sequence("tile", F.col("tiles") - 1)))
    right = dealt.withColumn("hi", F.col("tile")).withColumn("lo", F.explode(F.sequence(F.lit(0), "tile")))
    left, right = (x.select(*[F.col(c).alias(c) for c in ("id", "grp", "lo", "hi", "embedding")]) for x in (left, right))
    return left.groupBy("grp", "lo", "hi").cogroup(right.groupBy("grp", "lo", "hi")).applyInArrow(_near_in_tiles(threshold), "a long, b long, similarity double")


def greedy_drops(edges: DataFrame) -> DataFrame:
    """(id): what a pass in order drops that keeps a node unless an earlier kept one is its neighbour; edges: earlier, later.

    Rounds in place of the pass: a node without an earlier neighbour left is kept, its later neighbours are dropped, and all their edges
    go. As many rounds as the longest chain of neighbours has nodes, each over the edges that are left.
    """
    edges = lasting(edges.select("earlier", "later").distinct())
    dropped = []
    while not edges.isEmpty():
        heads = edges.select("earlier").distinct().join(edges.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti")
        out = lasting(edges.join(heads, "earlier").select(F.col("later").alias("id")).distinct())
        dropped.append(out)
        done = out.unionByName(heads.select(F.col("earlier").alias("id")))
        left = edges.join(done.select(F.col("id").alias("earlier")), "earlier", "left_anti")
        edges = lasting(left.join(out.select(F.col("id").alias("later")), "later", "left_anti"))
    return reduce(DataFrame.unionByName, dropped) if dropped else edges.select(F.col("later").alias("id"))


def _heads(left: DataFrame, threshold: float) -> DataFrame:
    """(id, grp, embedding, kept): the pass over the first HEAD of each group of left (id, grp, place, embedding)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        kept = np.ones(t.num_rows, bool)
        for at, u in _by_size(t).values():
            near = np.round(u @ u.T, 6) >= threshold
            for i in range(len(at)):
                kept[at[i]] = not (near[i, :i] & kept[at[:i]]).any()
        return t.select(["id", "grp", "embedding"]).append_column("kept", pa.array(kept))

    first = left.withColumn("k", F.row_number().over(W.partitionBy("grp").orderBy("place", "id"))).where(F.col("k") <= HEAD)
    return first.groupBy("grp").applyInArrow(run, "id long, grp {grp}, embedding {embedding}, kept boolean".format(**dict(left.dtypes)))


def _unlike(rest: DataFrame, kept: DataFrame, threshold: float) -> DataFrame:
    """The rows of rest (id, grp, place, embedding) that none of kept (grp, embedding) of their group is near: rest is dealt into parts of
    about TILE rows, each of which gets all of its group's kept ones."""

    def run(rows: pa.Table, others: pa.Table) -> pa.Table:
        free = np.ones(rows.num_rows, bool)
        if rows.num_rows and others.num_rows:
            known = _by_size(others)
            for n, (at, u) in _by_size(rows).items():
                if n in known:
                    for k in range(0, len(at), AT_ONCE):
                        free[at[k : k + AT_ONCE]] = ~(np.round(u[k : k + AT_ONCE] @ known[n][1].T, 6) >= threshold).any(axis=1)
        return rows.select(["id", "grp", "place", "embedding"]).filter(pa.array(free))

    parts = rest.groupBy(F.col("grp").alias("g")).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    same = F.col("grp").eqNullSafe(F.col("g"))
    rows = rest.join(parts, same).select("id", "grp", "place", "embedding", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    others = kept.join(parts, same).select("grp", "embedding", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return rows.groupBy("grp", "part").cogroup(others.groupBy("grp", "part")).applyInArrow(run, "id long, grp {grp}, place {place}, embedding {embedding}".format(**dict(rest.dtypes)))


def collapse_near(v: DataFrame, threshold: float = 0.965) -> DataFrame:
    """(id, kept): whether each of v (id, grp, place, embedding) stays when near vectors of its group that come earlier (by place, then
    id) push it out; a vector that was pushed out pushes nobody.

    Where many are near, the pairs grow with the square of a group, so they are not written: what the pass keeps of the first HEAD of
    each group is final and pushes out what it is near to, then the first HEAD of what is left, and so on. When by what was pushed out
    few pairs can be left (FEW for each vector), the rest is settled on its pairs. Null, empty and zero vectors stay.
    """
    even = F.coalesce(F.forall("embedding", lambda x: x.isNotNull()) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    left = lasting(v.where(even).select(F.col("id").cast("long").alias("id"), "grp", "place", "embedding"))
    stay, many = [], not left.isEmpty()
    while many:
        heads = lasting(_heads(left, threshold))
        kept = heads.where("kept")
        stay.append(kept.select("id"))
        was, left = left, lasting(_unlike(left.join(heads.select("id"), "id", "left_anti"), kept.select("grp", "embedding"), threshold))
        sizes = [t.select("grp", *[F.lit(int(k == i)).alias(c) for i, c in enumerate(("was", "heads", "now"))], held.alias("held")) for k, (t, held) in enumerate(((was, F.lit(0)), (heads, F.col("kept").cast("int")), (left, F.lit(0))))]
        sizes = reduce(DataFrame.unionByName, sizes).groupBy("grp").agg(*[F.sum(c).alias(c) for c in ("was", "heads", "now", "held")]).where("now > 0")
        n, pairs = sizes.agg(F.coalesce(F.sum("now"), F.lit(0)), F.sum(F.col("now") * F.col("now") / 2 * F.log((F.col("was") - F.col("heads")) / F.col("now")) / F.col("held"))).first()
        many = n > 0 and pairs > FEW * n
        if n and not many:
            stay.append(left.select("id").join(_dropped(left, threshold), "id", "left_anti"))
    found = reduce(DataFrame.unionByName, stay) if stay else left.select("id")
    return v.select("id", even.alias("even")).join(found.withColumn("stays", F.lit(True)), "id", "left").select("id", (~F.col("even") | F.col("stays").isNotNull()).alias("kept"))


def _dropped(v: DataFrame, threshold: float) -> DataFrame:
    """(id): what the pass over v (id, grp, place, embedding) pushes out, by all its near pairs."""
    pairs = near_pairs(v.select("id", "grp", "embedding"), threshold)
    at = v.select("id", F.struct("place", "id").alias("at"))
    placed = pairs.join(at.select(F.col("id").alias("a"), F.col("at").alias("x")), "a").join(at.select(F.col("id").alias("b"), F.col("at").alias("y")), "b")
    first = F.col("x") < F.col("y")
    edges = placed.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("earlier"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("later"))
    return greedy_drops(edges)


def vector_collapse(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of each label that stay, in order of their first value. The tables' vectors are nearly orthogonal: near is 0.2 here."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.round(-F.element_at("embedding", 1).cast("double"), 6).alias("place"), "embedding")
    return collapse_near(v, 0.2).select(F.col("id").alias("vec_id"), "kept")


def deletions(id_: Column, most: int) -> Column:
    """The strings that are left after deleting up to `most` characters."""
    out = F.array(id_)
    for _ in range(most):
        shorter = F.flatten(F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def within_edits(cited: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """(id, known, edits): all pairs of cited (id) and known (id) that at most `most` edits part, wherever these are.

    Two such strings have a string in common that `most` deletions leave of either, so that an equi-join of these finds every pair and
    spreads by the strings; distinct pairs are then measured. A string of n characters has about n ** most / 2 of them: this is for ids.
    """
    sides = [x.where("id IS NOT NULL").select("id").distinct() for x in (cited, known)]
    left, right = (s.select(F.col("id").alias(n), F.explode(deletions(F.col("id"), most)).alias("part")) for s, n in zip(sides, ("id", "known")))
    # merged: by the size of the ids' file Spark would broadcast all their parts
    pairs = left.join(right.hint("merge"), "part").select("id", "known").distinct()
    return pairs.withColumn("edits", F.levenshtein("id", "known", most)).where("edits >= 0")


def repair_ids(cited: DataFrame, known: DataFrame, most: int = 2) -> DataFrame:
    """(answer, id, repaired, edits, accepted) of cited (answer, id): the one nearest known id within `most` edits, null where several
    are as near or none is (edits: -1); an answer is accepted only if all its ids are repaired."""
    found = within_edits(cited, known, most)
    ties = found.groupBy("id", "edits").agg(F.count(F.lit(1)).alias("n"), F.min("known").alias("known"))
    best = ties.groupBy("id").agg(F.min(F.struct("edits", "n", "known")).alias("best"))
    best = best.select("id", F.when(F.col("best.n") == 1, F.col("best.known")).alias("repaired"), F.col("best.edits").cast("long").alias("edits"))
    rows = cited.select("answer", "id").join(best, "id", "left")
    accepted = F.min(F.col("repaired").isNotNull()).over(W.partitionBy("answer"))
    return rows.select("answer", "id", "repaired", F.coalesce("edits", F.lit(-1).cast("long")).alias("edits"), accepted.alias("accepted"))


_CITED = """SELECT c_custkey div 3 AS answer, CASE c_custkey % 7 WHEN 0 THEN k WHEN 1 THEN concat('Z', substr(k, 2)) WHEN 2 THEN concat(substr(k, 1, 3), substr(k, 5)) WHEN 3 THEN concat(substr(k, 1, 2), 'Z', substr(k, 3))
WHEN 4 THEN concat('Z', substr(k, 2, 6)) WHEN 5 THEN concat('ZZZ', substr(k, 4)) ELSE concat(substr(k, 2), 'Z') END AS id FROM (SELECT c_custkey, substr(md5(c_name), 1, 8) AS k FROM customer) AS c"""
_KNOWN = "SELECT DISTINCT substr(md5(c_name), 1, 8) AS id FROM customer"


def citation_repair(spark: SparkSession, d: str) -> DataFrame:
    """Ids cited by customers with none to three misspelt characters, the first ones too, repaired from the known ids."""
    return repair_ids(run_statement(spark, d, _CITED), run_statement(spark, d, _KNOWN))


def _distinct_words(label: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(label, F.lit("([\\p{L}\\p{N}]+)"), F.lit(1)))


def _jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def _numbers(words: Column) -> Column:
    return F.array_sort(F.filter(words, lambda w: w.rlike("^[0-9]+$")))


def _expanded(label: Column, abbreviations: dict[str, str]) -> Column:
    return reduce(lambda c, x: F.regexp_replace(c, rf"\b{x[0]}\b", x[1]), abbreviations.items(), label)


#: Score from which two labels are reviewed and merged; fixed values of the weights of equality, words, trigrams, abbreviations, numbers.
REVIEW, MERGE = 0.85, 0.94
WEIGHTS = (0.05, 0.40, 0.30, 0.15, 0.10)
#: Without equality the other weights leave (REVIEW - 0.55) / 0.40 to the words at least: the Jaccard similarity that the join must find.
LEAST_WORDS = 0.75


#: Words of a label, in their order by rarity, that are one mark together; labels of more words than LONG have marks of one word.
TOGETHER, LONG = 3, 12


def _marked(sets: DataFrame) -> DataFrame:
    """sets with mark in place of words (hashes, in one order over all sets), and their number as size: marks of which any two sets share
    one that share LEAST_WORDS of their words. held: the words of the mark; rest: how many of the set's words come after them.

    Each of the two has some `share` of its words at least in common with the other, so that TOGETHER of those stand among its first
    size - share + TOGETHER, and the same ones in both. Sets of one and two words have no others like them than equal ones.
    """
    n = F.size("words")
    spare = n - F.ceil(n * LEAST_WORDS).cast("int")
    sets = sets.withColumn("size", n).withColumn("first", F.slice("words", F.lit(1), F.least(spare + TOGETHER, n)))
    mark = lambda held, rest, hashed: F.struct(held.cast("int").alias("held"), rest.cast("int").alias("rest"), hashed.alias("mark"))
    at = lambda i: F.col("first")[i - 1]
    behind = lambda i, left, f: F.flatten(F.transform(F.sequence(i + 1, F.size("first") - left), f))
    last = lambda i, j: F.transform(F.sequence(j + 1, F.size("first")), lambda k: mark(F.lit(TOGETHER), F.col("size") - k, F.xxhash64(F.lit(TOGETHER), at(i), at(j), at(k))))
    threes = behind(F.lit(0), 2, lambda i: behind(i, 1, lambda j: last(i, j)))
    none = F.array().cast("array<struct<held int, rest int, mark bigint>>")
    few = F.when(F.col("size") < TOGETHER, F.array(mark(F.col("size"), F.lit(0), F.xxhash64("size", "words")))).when(F.col("size") * LEAST_WORDS <= LONG, threes).otherwise(none)
    ones = F.transform(F.slice("words", F.lit(1), F.size("first") - TOGETHER + 1), lambda w, k: mark(F.lit(1), F.col("size") - k - 1, F.xxhash64(F.lit(1), w)))
    marks = F.concat(few, F.when(F.col("size") > LONG, ones).otherwise(none))
    return sets.select(*[c for c in sets.columns if c not in ("words", "first")], F.explode(marks).alias("x")).select("*", "x.*").drop("x")


def alias_pairs(nodes: DataFrame, abbreviations: dict[str, str]) -> DataFrame:
    """(left_id, right_id, score, action): every two nodes (id, label, kind, parent) that may be merged: of one kind, not of different
    parents, without contradicting numbers, with a score of 0.85 or more (auto_merge from 0.94).

    Nodes of equal kind, label and parent are one (the smallest id stands for them; alias_members lists them), so that copies make no
    pairs. Others must share three quarters of their words: a join on marks of three words each, rarest words first, finds all such pairs
    without comparing a whole kind or nodes of different parents; what it finds is scored. Labels without words are left out.
    """
    reps = nodes.where("label IS NOT NULL AND kind IS NOT NULL").groupBy("kind", "label", "parent").agg(F.min("id").alias("id"))
    reps = lasting(reps.withColumn("words", _distinct_words(F.col("label"))).where(F.size("words") > 0))
    word = reps.select("id", "kind", "parent", F.explode(F.transform("words", lambda w: F.xxhash64(w))).alias("word"))
    usual = word.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n"))
    sets = word.join(usual.hint("merge"), ["kind", "word"]).groupBy("id", "kind", "parent").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("set"))
    marks = _marked(sets.select("id", "kind", "parent", F.transform("set", lambda x: x.word).alias("words")))
    # a node without parent meets all, another one those of its parent
    within = F.when(F.col("parent").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit(None).cast("string"), F.col("parent").cast("string")))
    a, b = marks.alias("a"), marks.withColumn("within", F.explode(within)).alias("b")
    on = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.mark") == F.col("b.mark")) & F.col("a.parent").cast("string").eqNullSafe(F.col("b.within"))
    once = F.when(F.col("a.parent").isNull() & F.col("b.parent").isNotNull(), F.col("a.id") != F.col("b.id")).otherwise(F.col("a.id") < F.col("b.id"))
    # by the first mark that two sets share they have no more in common than its words and the rest
    most = F.col("a.held") + F.least("a.rest", "b.rest")
    near = (F.col("a.held") == F.col("b.held")) & ((1 + LEAST_WORDS) * most >= LEAST_WORDS * (F.col("a.size") + F.col("b.size")))
    ids = [f(F.col("a.id"), F.col("b.id")).alias(c) for f, c in ((F.least, "left_id"), (F.greatest, "right_id"))]
    found = a.join(b.hint("merge"), on & once & near).select(*ids).distinct()
    whole = lambda side: reps.select(F.col("id").alias(f"{side}_id"), F.struct("label", "parent", "words").alias(side))
    pairs = found.join(whole("left"), "left_id").join(whole("right"), "right_id").where("left.parent IS NULL OR right.parent IS NULL OR left.parent = right.parent")
    pairs = pairs.where(_jaccard(F.col("left.words"), F.col("right.words")) >= LEAST_WORDS)
    x, y = _numbers(F.col("left.words")), _numbers(F.col("right.words"))
    some = (F.size(x) > 0).cast("int") + (F.size(y) > 0).cast("int")
    pairs = pairs.where((some < 2) | (x == y))
    parts = (
        (F.col("left.label") == F.col("right.label")).cast("double"),
        _jaccard(F.col("left.words"), F.col("right.words")),
        _jaccard(trigrams(F.col("left.label")), trigrams(F.col("right.label"))),
        (_expanded(F.col("left.label"), abbreviations) == _expanded(F.col("right.label"), abbreviations)).cast("double"),
        F.when(some == 1, 0.5).otherwise(1.0),
    )
    score = F.round(sum(w * p for w, p in zip(WEIGHTS, parts)) + 1e-9, 6)
    return pairs.select("left_id", "right_id", score.alias("score")).where(F.col("score") >= REVIEW).withColumn("action", F.when(F.col("score") >= MERGE, "auto_merge").otherwise("merge_review_needed"))


def alias_members(nodes: DataFrame) -> DataFrame:
    """(id, of): the node that stands for each."""
    same = W.partitionBy("kind", "label", "parent")
    return nodes.where("label IS NOT NULL AND kind IS NOT NULL").select("id", F.min("id").over(same).alias("of"))


#: Abbreviations that are equal to their words.
ABBREVIATIONS = {"dept": "department", "st": "street", "no": "number", "gov": "government"}
_NODES = "SELECT doc_id * 3 + pos AS id, lower(trim(regexp_replace(regexp_extract(line, R'^([^ ]+( +[^ ]+){0,7})', 1), R'[\\s]+', ' ', ALL))) AS label, lang AS kind, CASE WHEN doc_id % 4 = 0 THEN source END AS parent FROM (SELECT doc_id, lang, source, POSEX(HEAD(SPLIT(text, NEWLINE), 1, 2); pos, line) FROM documents) AS l"
SPARK_NODES, DUCK_NODES = both(_NODES)


def alias_merge(spark: SparkSession, d: str) -> DataFrame:
    """Labels: the first eight words of the first two lines of each document, of its language; every fourth document's
    stand under its source."""
    return alias_pairs(run_statement(spark, d, SPARK_NODES), ABBREVIATIONS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def one_to_one(pairs: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(grp, e, p): what a pass over the expected e of each group in order takes, where each takes the best p that is still free; pairs:
    grp, e, p, choice (a number; smaller is better, then the smaller p).

    copies (grp, p, of): further p that whatever takes `of` would take as well, so that they need no pairs of their own. The pass reads a
    group's pairs in order as a stream; what it holds is which p of the group are taken, and its copies.
    """
    kind = pairs.schema["grp"].dataType.simpleString()
    number = lambda c: F.col(c).cast("long").alias(c)
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    rows = pairs.select("grp", number("e"), F.col("choice").cast("double").alias("choice"), number("p"), none("long", "of"))
    if copies is not None:  # e is null: they come first
        rows = rows.unionByName(copies.select("grp", none("long", "e"), none("double", "choice"), number("p"), number("of")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        whole = lambda: pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["grp", "e", "p"])
        batches = iter(batches)
        if (first := next(batches, None)) is None:
            return
        types = (first.schema.field("grp").type, pa.int64(), pa.int64())
        for grp, group in groupby(_rows(chain([first], batches)), itemgetter(0)):
            taken: set[int] = set()
            more: dict[int, deque] = {}

            def free(p: int) -> int | None:
                """The first of p and its copies that nobody has."""
                if p not in taken:
                    return p
                left = more.get(p)
                while left and left[0] in taken:
                    left.popleft()
                return left[0] if left else None

            for e, asks in groupby(group, itemgetter(1)):
                if e is None:
                    for _, _, _, p, of in asks:
                        more.setdefault(of, deque()).append(p)
                    continue
                for _, alike in groupby(asks, itemgetter(2)):
                    if (best := min((q for x in alike if (q := free(x[3])) is not None), default=None)) is not None:
                        taken.add(best)
                        out.append((grp, e, best))
                        break
                if len(out) >= 1 << 14:
                    yield whole()
                    out.clear()
        yield whole()

    ordered = rows.where("grp IS NOT NULL").repartition("grp").sortWithinPartitions("grp", F.asc_nulls_first("e"), "choice", "p")
    return ordered.mapInArrow(run, f"grp {kind}, e long, p long")


def signature(text: Column) -> Column:
    """Lower case, words alone, one space between them, 255 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_\\s]", " "), "(?U)\\s+", " ")), 1, 255)


#: Sentences of either side that one task compares at once.
SENTENCES = 512


def _met(xs: list[str], ys: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which x meet which y, and their choice: -2 if one holds the other, or else minus the share of words if that is `least` or more."""
    by_size = sorted(range(len(ys)), key=lambda j: len(ys[j]))
    sizes = [len(ys[j]) for j in by_size]
    inside = np.zeros((len(xs), len(ys)), bool)
    for i, x in enumerate(xs):
        inside[i, [j for j in by_size[bisect_left(sizes, len(x)) :] if x in ys[j]]] = True
        inside[i, [j for j in by_size[: bisect_right(sizes, len(x))] if ys[j] in x]] = True
    words = [[set(t.split(" ")) for t in side] for side in (xs, ys)]
    known = {w: k for k, w in enumerate(set().union(*words[0]) & set().union(*words[1]))}
    has = [np.zeros((len(side), len(known)), np.float32) for side in words]
    for side, m in zip(words, has):
        for i, ws in enumerate(side):
            m[i, [known[w] for w in ws if w in known]] = 1
    most = np.maximum(*np.meshgrid(*(np.array([len(ws) for ws in side], float) for side in words), indexing="ij"))
    overlap = np.round((has[0] @ has[1].T).astype(float) / most, 9)
    i, j = np.nonzero(inside | (overlap >= least))
    return i, j, np.where(inside[i, j], -2.0, -overlap[i, j])


def _candidates(rows: DataFrame, least: float) -> DataFrame:
    """candidate_matches of rows (grp, side, at, sig), side: 0 expected, 1 predicted."""
    kind = rows.schema["grp"].dataType.simpleString()
    rows = rows.select("grp", F.col("side").cast("int").alias("side"), F.col("at").cast("long").alias("at"), "sig").where("grp IS NOT NULL AND sig IS NOT NULL AND (side = 0 OR sig <> '')")
    parts = lambda side: F.ceil(F.count_if(F.col("side") == side) / SENTENCES).cast("int")
    sizes = rows.groupBy("grp").agg(parts(0).alias("lows"), parts(1).alias("highs")).where("lows > 0 AND highs > 0")
    own, other = (F.when(F.col("side") == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("lows", "highs"), ("highs", "lows")))
    dealt = rows.join(sizes, "grp").withColumn("mine", F.pmod(F.xxhash64("at"), own).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), other - 1)))
    low, high = (F.when(F.col("side") == s, F.col("mine")).otherwise(F.col("theirs")) for s in (0, 1))
    tiles = dealt.select("grp", low.alias("low"), high.alias("high"), "side", "at", "sig").repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        if (first := next(batches, None)) is None:
            return
        grps, found, n = [], [[], [], []], 0
        whole = lambda: pa.record_batch([pa.array(grps, first.schema.field("grp").type), *(pa.array(np.concatenate(c) if c else np.zeros(0), t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64())))], names=["grp", "e", "p", "choice"])
        for (grp, *_), tile in groupby(_rows(chain([first], batches)), itemgetter(0, 1, 2)):
            sides = ([], [])
            for _, _, _, side, at, sig in tile:
                sides[side].append((at, sig))
            if sides[0] and sides[1]:
                i, j, choice = _met(*([sig for _, sig in x] for x in sides), least)
                grps += [grp] * len(i)
                for c, x in zip(found, (np.array([at for at, _ in sides[0]], np.int64)[i], np.array([at for at, _ in sides[1]], np.int64)[j], choice)):
                    c.append(x)
                n += len(i)
                if n >= 1 << 16:
                    yield whole()
                    grps, found, n = [], [[], [], []], 0
        yield whole()

    return tiles.mapInArrow(run, f"grp {kind}, e long, p long, choice double")


def candidate_matches(expected: DataFrame, predicted: DataFrame, least: float) -> DataFrame:
    """(grp, e, p, choice) of expected and predicted (grp, at, sig): one signature holds the other, or enough words are shared.

    A group's sentences are dealt into parts of about SENTENCES for either side, and each two parts are compared at once, so that a large
    group spreads over many tasks and only what meets leaves them. Empty predicted signatures match nothing, an empty expected one the first.
    """
    sides = [x.select("grp", F.lit(k).alias("side"), "at", "sig") for k, x in enumerate((expected, predicted))]
    return _candidates(sides[0].unionByName(sides[1]), least)


def _matches(spark: SparkSession, d: str, least: float) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("grp"), "turn", "role", F.posexplode(F.split("text", "[.]")).alias("pos", "sentence"))
    s = s.select("grp", (F.col("turn") * 1000 + F.col("pos")).cast("long").alias("at"), "role", signature(F.col("sentence")).alias("sig")).where("sig <> ''")
    sides = s.where("role IN ('user', 'assistant')").select("grp", (F.col("role") == "assistant").cast("int").alias("side"), "at", "sig")
    sides = sides.withColumn("of", F.min("at").over(W.partitionBy("grp", "side", "sig")))
    return s, one_to_one(_candidates(sides.where("side = 0 OR at = of"), least), sides.where("side = 1 AND at <> of").select("grp", F.col("at").alias("p"), "of"))


def match_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of users matched with those of assistants in their conversation, one to one, by half their words or more."""
    return _matches(spark, d, 0.5)[1].select(F.col("grp").alias("conv_id"), F.col("e").alias("expected"), F.col("p").alias("predicted"))


def match_scores(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of each conversation by those matches."""
    s, m = _matches(spark, d, 0.5)
    sizes = s.groupBy("grp").agg(F.count_if(F.col("role") == "user").alias("expected"), F.count_if(F.col("role") == "assistant").alias("predicted"))
    both_ = sizes.join(m.groupBy("grp").agg(F.count(F.lit(1)).alias("matched")), "grp", "left").na.fill(0, ["matched"])
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col("matched"), F.col(c)), F.lit(0.0)), 6)
    return both_.select(F.col("grp").alias("conv_id"), "expected", "predicted", "matched", rate("predicted").alias("precision"), rate("expected").alias("recall"))


QUERIES = {f.__name__: f for f in (vector_collapse, citation_repair, alias_merge, match_pairs, match_scores)}
_EXPAND = lambda c: reduce(lambda s, x: rf"regexp_replace({s}, '\b{x[0]}\b', '{x[1]}', 'g')", ABBREVIATIONS.items(), c)
_MATCHES = r"""
raw AS (SELECT conv_id, turn, role, unnest(string_split(text, '.')) AS sentence, unnest(range(len(string_split(text, '.')))) AS pos FROM conversations),
s AS (SELECT conv_id, CAST(turn * 1000 + pos AS BIGINT) AS at_, role, left(trim(regexp_replace(regexp_replace(lower(sentence), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), 255) AS sig FROM raw),
u AS (SELECT * FROM s WHERE sig <> ''),
pairs AS (SELECT e.conv_id, e.at_ AS e, p.at_ AS p, contains(e.sig, p.sig) OR contains(p.sig, e.sig) AS inside,
  round(len(list_intersect(list_distinct(string_split(e.sig, ' ')), list_distinct(string_split(p.sig, ' ')))) / greatest(len(list_distinct(string_split(e.sig, ' '))), len(list_distinct(string_split(p.sig, ' ')))), 9) AS o
  FROM u e JOIN u p ON e.conv_id = p.conv_id WHERE e.role = 'user' AND p.role = 'assistant'),
prefs AS (SELECT conv_id, e, list(p ORDER BY NOT inside, CASE WHEN inside THEN 0 ELSE -o END, p) AS ps FROM pairs WHERE inside OR o >= 0.5 GROUP BY conv_id, e),
nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY e) AS k FROM prefs),
step AS (SELECT conv_id, 0::BIGINT AS k, NULL::BIGINT AS e, NULL::BIGINT AS pick, []::BIGINT[] AS used FROM (SELECT DISTINCT conv_id FROM prefs)
  UNION ALL SELECT r.conv_id, n.k, n.e, list_filter(n.ps, lambda x: NOT list_contains(r.used, x))[1], CASE WHEN list_filter(n.ps, lambda x: NOT list_contains(r.used, x))[1] IS NULL THEN r.used ELSE list_append(r.used, list_filter(n.ps, lambda x: NOT list_contains(r.used, x))[1]) END
  FROM step r JOIN nth n ON n.conv_id = r.conv_id AND n.k = r.k + 1),
m AS (SELECT conv_id, e AS expected, pick AS predicted FROM step WHERE pick IS NOT NULL)"""
ORACLE_SQL = {
    "vector_collapse": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY round(-embedding[1]::DOUBLE, 6), vec_id) AS k FROM embeddings),
near AS (SELECT b.vec_id, list(a.vec_id) AS others FROM v a JOIN v b ON a.label = b.label AND a.k < b.k WHERE round(list_cosine_similarity(a.x, b.x), 6) >= 0.2 GROUP BY b.vec_id),
w AS (SELECT v.vec_id, label, k, coalesce(others, []) AS others FROM v LEFT JOIN near USING (vec_id)),
r AS (SELECT label, 0::BIGINT AS k, NULL::BIGINT AS vec_id, []::BIGINT[] AS kept FROM (SELECT DISTINCT label FROM w)
  UNION ALL SELECT w.label, w.k, w.vec_id, CASE WHEN list_has_any(r.kept, w.others) THEN r.kept ELSE list_append(r.kept, w.vec_id) END FROM r JOIN w ON w.label = r.label AND w.k = r.k + 1)
SELECT vec_id, list_contains(kept, vec_id) AS kept FROM r WHERE vec_id IS NOT NULL""",
    "citation_repair": f"""
WITH c AS ({_CITED.replace(" div ", " // ")}), k AS ({_KNOWN}), d AS (SELECT c.id, k.id AS known, levenshtein(c.id, k.id) AS edits FROM (SELECT DISTINCT id FROM c) c JOIN k ON levenshtein(c.id, k.id) <= 2),
b AS (SELECT id, min(edits) AS edits FROM d GROUP BY id), n AS (SELECT d.id, b.edits, count(*) AS n, max(known) AS known FROM d JOIN b ON d.id = b.id AND d.edits = b.edits GROUP BY ALL),
r AS (SELECT c.answer, c.id, CASE WHEN n = 1 THEN known END AS repaired, coalesce(edits, -1) AS edits FROM c LEFT JOIN n ON n.id = c.id) SELECT *, min(repaired IS NOT NULL) OVER (PARTITION BY answer) AS accepted FROM r""",
    "alias_merge": rf"""
WITH n AS ({DUCK_NODES}), g AS (SELECT kind, label, parent, min(id) AS id FROM n WHERE label IS NOT NULL GROUP BY ALL),
w AS (SELECT *, list_distinct(regexp_extract_all(label, '[\p{{L}}\p{{N}}]+')) AS w, CASE WHEN length(label) >= 3 THEN list_distinct(list_transform(range(1, length(label) - 1), lambda i: substr(label, i, 3))) WHEN label <> '' THEN [label] ELSE [] END AS g FROM g),
x AS (SELECT *, list_sort(list_filter(w, lambda t: regexp_full_match(t, '[0-9]+'))) AS numbers, {_EXPAND("label")} AS expanded FROM w WHERE len(w) > 0),
s AS (SELECT a.id AS left_id, b.id AS right_id, round(0.05::DOUBLE * (a.label = b.label)::INT + 0.4::DOUBLE * (len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))) + 0.3::DOUBLE * (len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))))
  + 0.15::DOUBLE * (a.expanded = b.expanded)::INT + 0.1::DOUBLE * CASE WHEN (len(a.numbers) > 0) <> (len(b.numbers) > 0) THEN 0.5 ELSE 1 END + 0.000000001::DOUBLE, 6) AS score
  FROM x a JOIN x b ON a.kind = b.kind AND a.id < b.id WHERE (a.parent IS NULL OR b.parent IS NULL OR a.parent = b.parent) AND NOT (len(a.numbers) > 0 AND len(b.numbers) > 0 AND a.numbers <> b.numbers))
SELECT *, CASE WHEN score >= 0.94 THEN 'auto_merge' ELSE 'merge_review_needed' END AS action FROM s WHERE score >= 0.85""",
    "match_pairs": f"WITH RECURSIVE {_MATCHES} SELECT * FROM m",
    "match_scores": f"""WITH RECURSIVE {_MATCHES}, c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS expected, count(*) FILTER (role = 'assistant') AS predicted FROM u GROUP BY conv_id), n AS (SELECT conv_id, count(*) AS matched FROM m GROUP BY conv_id)
SELECT c.conv_id, expected, predicted, coalesce(matched, 0) AS matched, round(coalesce(matched / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(matched / nullif(expected, 0), 0), 6) AS recall FROM c LEFT JOIN n USING (conv_id)""",
}
