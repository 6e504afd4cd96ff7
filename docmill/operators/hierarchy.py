"""Parents of any depth: levels, roots, paths and cycles by pointer doubling, and the nearest ancestor of a kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.relational import run_statement
from docmill.plans.dialects import both
from docmill.sources.tables import lasting


def _one_each(nodes: DataFrame, *columns: str) -> DataFrame:
    """A row for each id (of several the least), with parents that aren't there taken away."""
    one = nodes.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("parent", *columns)).alias("x")).select("id", "x.*")
    known = one.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    return one.join(known, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("parent"), *columns)


def paths(nodes: DataFrame, separator: str = " > ") -> DataFrame:
    """(id, root, depth, path, key, cyclic) of nodes (id, parent, title): the way from the root, the hash of all titles on it, and
    whether the node lies on or below a cycle (root, depth, path and key are null then).

    Each round every open node jumps to where its pointer's pointer leads and takes over that stretch's titles, so that depth n takes
    log2(n) rounds. A round that finishes no node leaves only cycles. A parent that isn't there counts as none.
    """
    done = None
    open_ = lasting(_one_each(nodes, "title").select("id", F.col("parent").alias("up"), F.col("id").alias("top"), F.lit(0).alias("depth"), F.coalesce("title", F.lit("")).alias("path")))
    while True:
        finished = lasting(open_.where("up IS NULL").select("id", F.col("top").alias("root"), "depth", "path"))
        done = finished if done is None else done.unionByName(finished)
        rest = open_.where("up IS NOT NULL")
        if finished.isEmpty() or rest.isEmpty():
            break
        # what a pointer leads to is open, with a stretch of its own, or finished, with all of its way
        stops = open_.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("top").alias("via"), F.col("depth").alias("more"), F.col("path").alias("before"))
        older = done.join(finished.select("id"), "id", "left_anti").select(F.col("id").alias("up"), F.lit(None).cast(nodes.schema["id"].dataType).alias("next"), F.col("root").alias("via"), F.col("depth").alias("more"), F.col("path").alias("before"))
        jumped = rest.join(stops.unionByName(older), "up")
        open_ = lasting(jumped.select("id", F.col("next").alias("up"), F.col("via").alias("top"), (F.col("depth") + F.col("more") + 1).alias("depth"), F.concat("before", F.lit(separator), "path").alias("path")))
    known = done.select("*", F.sha1("path").alias("key"), F.lit(False).alias("cyclic"))
    none = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("root", "depth", "path", "key")]
    return known.unionByName(rest.select("id", *none, F.lit(True).alias("cyclic")))


def nearest_of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    """(id, ancestor, steps) of nodes (id, parent, kind): the nearest ancestor of a kind, null if none is on the way up. A cycle without
    one ends like a way without one."""
    one = _one_each(nodes, "kind")
    of = one.where(F.col("kind") == kind).select(F.col("id").alias("up"), F.lit(True).alias("fits"))
    state = one.select("id", F.col("parent").alias("up")).join(of, "up", "left").select("id", "up", F.coalesce("fits", F.lit(False)).alias("found"), F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("steps"))
    state = lasting(state)
    total, most = state.count(), 1
    while most < 2 * total:
        searching = state.where("up IS NOT NULL AND NOT found")
        if searching.isEmpty():
            break
        stops = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("found").alias("there"), F.col("steps").alias("more"))
        moved = searching.join(stops, "up").select("id", F.col("next").alias("up"), F.col("there").alias("found"), (F.col("steps") + F.col("more")).alias("steps"))
        state = lasting(moved.unionByName(state.where("up IS NULL OR found")))
        most *= 2
    return state.select("id", F.when(F.col("found"), F.col("up")).alias("ancestor"), F.when(F.col("found"), F.col("steps")).alias("steps"))


#: Chains of 25 documents, of which every fourth hangs on the one before and every ninth is closed to a cycle; some parents are missing.
_CHAINS = """SELECT doc_id AS id, CASE WHEN doc_id % 25 <> 0 THEN doc_id - 1 WHEN (doc_id div 25) % 9 = 5 THEN doc_id + 24 WHEN (doc_id div 25) % 4 = 1 THEN doc_id - 1 WHEN (doc_id div 25) % 4 = 3 THEN -7 END AS parent,
source AS title, CASE WHEN doc_id % 6 = 2 THEN 'folder' ELSE 'page' END AS kind FROM documents"""


def parent_chains(spark: SparkSession, d: str) -> DataFrame:
    """The ways of chained documents."""
    found = paths(run_statement(spark, d, _CHAINS))
    return found.select("id", F.coalesce("root", F.lit(-1).cast("long")).alias("root"), F.coalesce("depth", F.lit(-1)).cast("long").alias("depth"), F.coalesce("key", F.lit("")).alias("key"), "cyclic")


def nearest_folder(spark: SparkSession, d: str) -> DataFrame:
    """The nearest folder above each chained document."""
    return nearest_of_kind(run_statement(spark, d, _CHAINS), "folder").select("id", F.coalesce("ancestor", F.lit(-1).cast("long")).alias("ancestor"), F.coalesce("steps", F.lit(-1)).cast("long").alias("steps"))


QUERIES = {f.__name__: f for f in (parent_chains, nearest_folder)}
_DUCK = both(_CHAINS)[1].replace(" div ", " // ")
ORACLE_SQL = {
    "parent_chains": f"""
WITH RECURSIVE c AS ({_DUCK}), n AS (SELECT id, title, CASE WHEN parent IN (SELECT id FROM c) THEN parent END AS parent FROM c),
t AS (SELECT id, id AS root, 0 AS depth, title AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.root, t.depth + 1, t.path || ' > ' || n.title FROM t JOIN n ON n.parent = t.id)
SELECT n.id, coalesce(root, -1) AS root, coalesce(depth, -1) AS depth, coalesce(sha1(path), '') AS key, root IS NULL AS cyclic FROM n LEFT JOIN t ON t.id = n.id""",
    "nearest_folder": f"""
WITH RECURSIVE c AS ({_DUCK}), n AS (SELECT id, kind, CASE WHEN parent IN (SELECT id FROM c) THEN parent END AS parent FROM c),
t AS (SELECT n.id, n.parent AS up, p.kind, 1 AS steps FROM n JOIN n p ON p.id = n.parent UNION ALL SELECT t.id, n.parent, p.kind, t.steps + 1 FROM t JOIN n ON n.id = t.up JOIN n p ON p.id = n.parent WHERE t.kind <> 'folder' AND t.steps < 60),
f AS (SELECT id, up, steps FROM t WHERE kind = 'folder') SELECT n.id, coalesce(up, -1) AS ancestor, coalesce(steps, -1) AS steps FROM n LEFT JOIN f ON f.id = n.id""",
}
