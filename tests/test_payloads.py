"""The brace scanner and the contract: golden payloads, nested and broken ones, odd rows."""

import json
import random

import pytest

from docmill.operators import payloads as p

SPAN = {"span_id": "s1", "category": "decision", "start_offset": 10, "end_offset": 30, "text": "הוחלט לאשר תקציב", "confidence": 0.82, "regex_boost": 0.06, "hint_terms": ["הוחלט", "תקציב"]}
NODE = {"candidate_id": "n1", "label_he": "אישור תקציב", "node_kind": "topic", "semantic_type": "budget_item", "mentions": [{"mention_text": "אישור תקציב", "start_offset": 11, "end_offset": 22}], "evidence_span_ids": ["s1"]}
GOOD = {"evidence_spans": [SPAN], "nodes": [NODE]}


def test_a_good_payload_has_no_issues():
    assert p.contract_issues(GOOD) == []


def test_a_lost_reference_is_reported():
    payload = {"evidence_spans": [], "nodes": [NODE | {"evidence_span_ids": ["s-missing"]}]}
    assert p.contract_issues(payload) == [("node_evidence_refs_missing", "nodes[0].evidence_span_ids", "unknown evidence_span_ids: s-missing")]


@pytest.mark.parametrize(
    "change,want",
    [
        ({"evidence_spans": None}, ["evidence_spans_missing", "node_evidence_refs_missing"]),
        ({"evidence_spans": {}}, ["evidence_spans_invalid", "node_evidence_refs_missing"]),
        ({"evidence_spans": ["x", SPAN]}, ["evidence_span_invalid"]),
        ({"evidence_spans": [SPAN, SPAN | {"start_offset": True}]}, ["evidence_span_required_fields"]),
        ({"evidence_spans": [SPAN | {"start_offset": " -3 "}]}, []),
        ({"evidence_spans": [SPAN, SPAN | {"category": "x"}]}, ["evidence_span_category_invalid"]),
        ({"nodes": None, "edges": 3}, ["nodes_missing"]),
        ({"nodes": [1, NODE | {"label_he": " "}, NODE | {"node_kind": "place"}]}, ["node_invalid", "node_required_fields", "node_kind_invalid"]),
        ({"nodes": [NODE | {"mentions": {}, "aliases": [{}, 1]}]}, ["mentions_invalid", "alias_required_fields", "alias_invalid"]),
        ({"nodes": [NODE | {"mentions": [7, {"mention_text": "x"}], "aliases": "a"}]}, ["mention_invalid", "mention_required_fields", "aliases_invalid"]),
        ({"edges": "x", "decision_links": [{}], "chunk_links": [{"chunk_id": "c"}], "rejects": [{"reason_code": "NEW"}, 4]}, ["edges_invalid", "decision_link_required_fields", "chunk_link_required_fields", "reject_reason_unknown", "reject_invalid"]),
        ({"edges": [{"source_candidate_id": "a", "target_candidate_id": "b", "relation_type": "near"}], "decision_links": [{"decision_id": "5", "node_candidate_id": "n1", "relation_role": "x"}]}, ["edge_relation_invalid", "decision_link_role_invalid"]),
    ],
)
def test_each_rule(change, want):
    assert [code for code, *_ in p.contract_issues(GOOD | change)] == want


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": {"b": "}{"}}\n```', {"a": {"b": "}{"}}),
        ('so: {not json} then {"a": "x\\"}"} and {"b": 2}', {"a": 'x"}'}),
        ('"quoted" {"a": 1}', {"a": 1}),
        ("[1, 2]", None), ('{"a": 1', None), ("", None), (None, None), ("{" * 100000, None), ('{"a": [{"b": {}}]} tail }', {"a": [{"b": {}}]}),
    ],
)
def test_salvage(text, want):
    assert p.salvage(text) == want


def test_objects_round_trip():
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return {f"k{i}": value(depth - 1) for i in range(rng.randrange(3))}
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return ["a{b}\\\"" * rng.randrange(3), rng.randrange(9), None, "}" * rng.randrange(3)][kind]

    for _ in range(200):
        given = [{"x": value(3)} for _ in range(rng.randrange(4))]
        text = "say ] ".join(["", *(json.dumps(g) for g in given)]) + " }"
        assert [json.loads(x) for x in p.objects_in(text)] == given


def test_rows(spark):
    rows = [(1, json.dumps(GOOD), "c"), (2, None, "c"), (None, "{}", "c"), (3, "none", "c"), (1, json.dumps(GOOD), "c")]
    frame = spark.createDataFrame(rows, "id long, raw string, code string")
    got = sorted((str(r.id), r.nth, r.code) for r in p.check_payloads(frame).collect())
    assert got == [("1", 0, "ok"), ("1", 0, "ok"), ("2", 0, "no_object"), ("3", 0, "no_object"), ("None", 0, "evidence_spans_missing"), ("None", 1, "nodes_missing")]
    assert p.check_payloads(frame.limit(0)).count() == 0
    assert {(r.id, r.found, r.body) for r in p.salvage_json(spark.createDataFrame([(1, 'x {"b": 1, "a": "é"}', "c"), (2, "", "c")], "id long, raw string, found string")).collect()} == {(1, True, '{"a": "é", "b": 1}'), (2, False, None)}
