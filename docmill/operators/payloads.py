"""Objects in free text, and the contract that extracted graphs are held against."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.sources.tables import table


def objects_in(text: str) -> Iterator[str]:
    """The outermost balanced {...} of a text, in order. Braces inside strings don't count, nor do quotes behind a backslash; what is
    never closed ends the search."""
    depth, begin, inside, skip = 0, 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == "{":
            depth += 1
            if depth == 1:
                begin = i
        elif depth and c == "}":
            depth -= 1
            if not depth:
                yield text[begin : i + 1]
        elif depth and c == '"':
            inside = True


def salvage(text: str | None) -> dict | None:
    """The first JSON object in a text that may fence, introduce or follow it; None if there is none."""
    for part in [text or "", *objects_in(text or "")]:
        try:
            found = json.loads(part)
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict):
            return found
    return None


def as_text(value) -> str | None:
    return (value.strip() or None) if isinstance(value, str) else None


def as_int(value) -> int | None:
    if isinstance(value, str) and value.strip().lstrip("-").isdigit():
        return int(value.strip().lstrip("-")) * (-1 if value.strip().startswith("-") else 1)
    return value if isinstance(value, int) and not isinstance(value, bool) else None


@dataclass(frozen=True)
class Items:
    """What a list of a payload holds: its items' fields and kinds, a field of fixed values, and lists inside the items.

    code: the first part of the codes of its issues; enum_code: the last part for a wrong value; strict: a missing list is an issue;
    lenient: an item with a wrong value stays.
    """

    code: str
    required: tuple[tuple[str, str], ...]
    enum: str | None = None
    enum_code: str = ""
    enum_message: str = ""
    values: tuple[str, ...] = ()
    strict: bool = False
    lenient: bool = False
    inner: tuple[tuple[str, Items], ...] = field(default=())


# Fixed values of the contract: fields, codes, messages and the words that they allow.
_MENTIONS = Items("mention", (("mention_text", "text"), ("start_offset", "int"), ("end_offset", "int")))
_ALIASES = Items("alias", (("alias_label_he", "text"),))
CONTRACT = {
    "evidence_spans": Items(
        "evidence_span", (("span_id", "text"), ("category", "text"), ("start_offset", "int"), ("end_offset", "int"), ("text", "text")), "category", "category_invalid", "category is invalid",
        ("decision", "plan_program", "discussion", "policy", "budget_finance", "implementation", "procurement_legal", "public_feedback"), strict=True,
    ),
    "nodes": Items(
        "node", (("candidate_id", "text"), ("label_he", "text"), ("node_kind", "text"), ("semantic_type", "text")), "node_kind", "kind_invalid", "node_kind must be topic or entity",
        ("topic", "entity"), strict=True, inner=(("mentions", _MENTIONS), ("aliases", _ALIASES)),
    ),
    "edges": Items("edge", (("source_candidate_id", "text"), ("target_candidate_id", "text"), ("relation_type", "text")), "relation_type", "relation_invalid", "relation_type is invalid", ("related", "same_as", "replaced_by", "supports")),
    "decision_links": Items("decision_link", (("decision_id", "int"), ("node_candidate_id", "text"), ("relation_role", "text")), "relation_role", "role_invalid", "relation_role is invalid", ("subject", "object", "location", "budget_scope", "program_scope")),
    "chunk_links": Items("chunk_link", (("chunk_id", "text"), ("node_candidate_id", "text"))),
    "rejects": Items(
        "reject", (("reason_code", "text"),), "reason_code", "reason_unknown", "reason_code is unknown; normalized to UNSUPPORTED_SCHEMA",
        ("EMPTY_LABEL", "NUMERIC_ONLY_LABEL", "STOPWORDS_ONLY", "TOO_GENERIC", "SPAN_OUT_OF_RANGE", "SPAN_TEXT_MISMATCH", "PAGE_RESOLUTION_FAILED", "MERGE_REVIEW_NEEDED", "HIERARCHY_INTEGRITY", "UNSUPPORTED_SCHEMA"), lenient=True,
    ),
}


def _walk(value, name: str, path: str, spec: Items, issues: list, plural: str) -> list[dict]:
    """The valid items of a list; issues gets (code, path, message) of the others."""
    if not isinstance(value, list):
        if value is not None or spec.strict:
            issues.append((f"{plural}_{'missing' if value is None or name == 'nodes' else 'invalid'}", path, f"{name} must be a list"))
        return []
    good = []
    for i, item in enumerate(value):
        at = f"{path}[{i}]"
        if not isinstance(item, dict):
            issues.append((f"{spec.code}_invalid", at, f"{spec.code.replace('_', ' ')} must be object"))
            continue
        got = {f: (as_text if kind == "text" else as_int)(item.get(f)) for f, kind in spec.required}
        if any(v is None for v in got.values()):
            names = ", ".join(got)
            issues.append((f"{spec.code}_required_fields", at, f"{names} {'are' if len(got) > 1 else 'is'} required"))
            continue
        if spec.enum and got[spec.enum] not in spec.values:
            issues.append((f"{spec.code}_{spec.enum_code}", f"{at}.{spec.enum}", spec.enum_message))
            if not spec.lenient:
                continue
        for inner, inside in spec.inner:
            _walk(item.get(inner), inner, f"{at}.{inner}", inside, issues, inner)
        good.append(item | got)
    return good


def contract_issues(payload: dict) -> list[tuple[str, str, str]]:
    """(code, path, message) of all that is wrong with a payload, list by list; without a list of nodes nothing behind it is read."""
    issues: list[tuple[str, str, str]] = []
    spans: set[str] = set()
    for name, spec in CONTRACT.items():
        good = _walk(payload.get(name), name, name, spec, issues, name)
        if name == "evidence_spans":
            spans = {x["span_id"] for x in good}
        if name == "nodes":
            if not isinstance(payload.get(name), list):
                break
            for i, node in enumerate(good):
                named = [as_text(x) for x in node["evidence_span_ids"]] if isinstance(node.get("evidence_span_ids"), list) else []
                if lost := [x for x in named if x and x not in spans]:
                    issues.append(("node_evidence_refs_missing", f"nodes[{i}].evidence_span_ids", f"unknown evidence_span_ids: {', '.join(lost)}"))
    return issues


def check_payloads(rows: DataFrame) -> DataFrame:
    """(id, nth, code, path, message) of rows (id, raw): a row for each issue of the object in the raw text; code `ok` if there is none,
    `no_object` where the text has no JSON object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, raw in zip(batch.column("id").to_pylist(), batch.column("raw").to_pylist()):
                found = salvage(raw)
                issues = [("no_object", "", "")] if found is None else contract_issues(found) or [("ok", "", "")]
                out += [(i, k, *x) for k, x in enumerate(issues)]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["id", "nth", "code", "path", "message"])

    return rows.select(F.col("id").cast("long").alias("id"), F.col("raw").cast("string").alias("raw")).mapInArrow(run, "id long, nth long, code string, path string, message string")


def salvage_json(rows: DataFrame) -> DataFrame:
    """(id, found, body) of rows (id, raw): the object in each raw text, written with sorted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [salvage(x) for x in batch.column("raw").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array([x is not None for x in found]), pa.array([None if x is None else json.dumps(x, sort_keys=True, ensure_ascii=False) for x in found], pa.string())], names=["id", "found", "body"])

    return rows.select(F.col("id").cast("long").alias("id"), F.col("raw").cast("string").alias("raw")).mapInArrow(run, "id long, found boolean, body string")


def payload_issues(spark: SparkSession, d: str) -> DataFrame:
    """Answers made of the events, each with the fault that its id names: as an extraction would return them, fenced and introduced."""
    kind = F.pmod("event_id", F.lit(8))
    name = lambda c: F.concat(F.lit(c), F.col("event_id"))
    span = F.struct(name("s").alias("span_id"), F.when(kind == 1, "gossip").otherwise("decision").alias("category"), F.lit(0).alias("start_offset"), F.length("event_type").alias("end_offset"), F.when(kind == 2, " ").otherwise(F.concat_ws(" {", "event_type", F.lit('"}'))).alias("text"))
    mention = F.struct(F.col("event_type").alias("mention_text"), F.when(kind != 3, 0).alias("start_offset"), F.lit(1).alias("end_offset"))
    node = F.struct(name("n").alias("candidate_id"), F.col("event_type").alias("label_he"), F.when(kind == 4, "place").otherwise("topic").alias("node_kind"), F.lit("event").alias("semantic_type"), F.array(mention).alias("mentions"), F.array(name(" s"), F.when(kind == 5, "lost")).alias("evidence_span_ids"))
    edge = F.struct(name("n").alias("source_candidate_id"), F.col("user_id").cast("string").alias("target_candidate_id"), F.lit("related").alias("relation_type"))
    body = F.to_json(F.struct(F.array(span).alias("evidence_spans"), F.when(kind != 6, F.array(node)).alias("nodes"), F.array(edge).alias("edges")))
    raw = F.concat(F.lit("Here it is {see below:\n```json\n"), F.when(kind == 7, F.expr("left(replace(x, '}', ''), 200)")).otherwise(F.col("x")), F.lit("\n``` {done}"))
    rows = table(spark, d, "events").withColumn("x", body)
    # what stands before the fence opens a brace that is never closed: the scanner needs the text from the fence on
    return check_payloads(rows.select(F.col("event_id").alias("id"), F.regexp_extract(raw, "(?s)(```.*)", 1).alias("raw"))).select(F.col("id").alias("event_id"), "nth", "code", "path", "message")


QUERIES = {"payload_issues": payload_issues}
ORACLE_SQL = {
    # the faults are known by how the answers are made
    "payload_issues": """
SELECT event_id, 0 AS nth, CASE event_id % 8 WHEN 1 THEN 'evidence_span_category_invalid' WHEN 2 THEN 'evidence_span_required_fields' WHEN 3 THEN 'mention_required_fields' WHEN 4 THEN 'node_kind_invalid' WHEN 5 THEN 'node_evidence_refs_missing' WHEN 6 THEN 'nodes_missing' WHEN 7 THEN 'no_object' ELSE 'ok' END AS code,
CASE event_id % 8 WHEN 1 THEN 'evidence_spans[0].category' WHEN 2 THEN 'evidence_spans[0]' WHEN 3 THEN 'nodes[0].mentions[0]' WHEN 4 THEN 'nodes[0].node_kind' WHEN 5 THEN 'nodes[0].evidence_span_ids' WHEN 6 THEN 'nodes' ELSE '' END AS path,
CASE event_id % 8 WHEN 1 THEN 'category is invalid' WHEN 2 THEN 'span_id, category, start_offset, end_offset, text are required' WHEN 3 THEN 'mention_text, start_offset, end_offset are required' WHEN 4 THEN 'node_kind must be topic or entity' WHEN 5 THEN 'unknown evidence_span_ids: lost' WHEN 6 THEN 'nodes must be a list' ELSE '' END AS message FROM events
UNION ALL SELECT event_id, 1, 'node_evidence_refs_missing', 'nodes[0].evidence_span_ids', concat('unknown evidence_span_ids: s', event_id) FROM events WHERE event_id % 8 IN (1, 2)""",
}
