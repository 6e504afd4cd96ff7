"""Merging of spans and grounding of quotes: golden rows, brute force, every branch, odd rows."""

import random

import pytest

from docmill.operators import spans as s

DOCS = f"doc_id long, text string, spans array<{s.SPAN}>, number string, parts int"


def merged(spark, rows):
    out = s.merge_spans(spark.createDataFrame([(i, t, x, "n", 1) for i, t, x in rows], DOCS)).collect()
    return sorted(tuple(r) for r in out)


def test_neighbours_join_over_short_separators_only(spark):
    text = "approve the budget, and the plan\nnext line here. Another one; more of it" + " " * 70 + "far away"
    at = lambda part: (text.index(part), text.index(part) + len(part))
    span = lambda part, number=None, confidence=0.5: (*at(part), number, confidence)
    parts = [span("far away"), span("approve the budget"), span("and the plan", "7", 0.8), span("next line here"), span("Another one", "1"), span("more of it", "2", 0.9)]
    got = merged(spark, [(1, text, parts)])
    assert got == [
        (1, 0, at("and the plan")[1], "7", 0.8, 2),  # a comma between
        (1, *at("next line here"), None, 0.5, 1),  # a line break before, a full stop behind
        (1, at("Another one")[0], at("more of it")[1], "1", 0.9, 2),
        (1, *at("far away"), None, 0.5, 1),  # 70 blanks
    ]


def test_connectors_and_headings_keep_decisions_apart(spark):
    for between, count in ((" , ", 1), (" וכן ", 2), (" כמו  כן ", 2), (" בנוסף ", 2), (" החלטה ", 2), ("", 2)):
        text = "אישור תקציב" + between + "מינוי ועדה"
        spans = [(0, 11, None, 0.5), (11 + len(between), len(text), None, 0.5)]
        if between:
            assert len(merged(spark, [(1, text, spans)])) == count, between


def test_overlaps_join_if_one_holds_the_other(spark):
    text = "the council decided to approve the new budget for schools today"
    inside = [(0, 45, "3", 0.4), (4, 45, None, 0.9)]
    assert merged(spark, [(1, text, inside)]) == [(1, 0, 45, "3", 0.9, 2)]
    assert len(merged(spark, [(1, text, [(0, 30, None, 0.4), (20, 63, None, 0.9)])])) == 2  # a third shared
    # the state is the merged predecessor: the third span is held against both together
    assert merged(spark, [(1, text, [(0, 45, None, 0.4), (4, 45, None, 0.5), (4, 20, None, 0.6)])]) == [(1, 0, 45, None, 0.6, 3)]


def test_odd_spans(spark):
    rows = [(1, None, [(0, 1, None, 0.1)]), (2, "", []), (3, "abc", None), (4, "abc", [None, (2, 1, None, 0.1), (0, 9, None, 0.1), (-1, 2, None, 0.1), (0, 3, None, None)]), (None, "abc", [(0, 1, None, 0.5), (0, 1, None, 0.5)]), (5, "x " * 100000, [(0, 1, "1", 0.5), (199998, 199999, "2", 0.5)])]
    got = s.merge_spans(spark.createDataFrame([(i, t, x, "n", 1) for i, t, x in rows], DOCS)).collect()
    assert {tuple(r) for r in got} == {(4, 0, 3, None, 0.0, 1), (None, 0, 1, None, 0.5, 2), (5, 0, 1, "1", 0.5, 1), (5, 199998, 199999, "2", 0.5, 1)}
    assert merged(spark, []) == []


TEXT = "First point. The council approved the new budget of the school, after a debate; it was long. Then they closed the meeting.\nLast line of it"


@pytest.mark.parametrize(
    "quote,window,offsets,want",
    [
        ("  The council approved  ", (0, 50), (None, None), ("exact", "The council approved")),
        ("council approved the NEW budgets of the school", (0, 50), (None, None), ("fuzzy", "council approved the new budget of the school, after a debate; it was long.")),
        ("The council approved the new budget of the school", (5000, 5001), (13, 60), ("offset_mismatch", None)),  # grown to its sentence, less than four fifths
        ("closed the meeting", (5000, 5001), (98, 116), ("offset_mismatch", None)),
        ("They closed the meeting, then", (5000, 5001), (98, 116), ("offset", "Then they closed the meeting.")),
        ("school meeting", (5000, 5001), (13, 60), ("offset_mismatch", None)),
        ("ouncil approved", (0, 50), (None, None), ("exact", "The council approved the new budget of the school, after a debate; it was long.")),  # in the middle of a word
        ("other things were never said", (0, 50), (None, None), ("span_unresolved", None)),
        ("other things", (0, 50), (5, 5), ("span_unresolved", None)),
        (" ", (0, 50), (0, 5), ("missing_text", None)),
        (None, (0, 50), (0, 5), ("missing_text", None)),
    ],
)
def test_grounding(spark, quote, window, offsets, want):
    start, end, how = s.ground(TEXT, quote, window, offsets)
    assert (how, None if start is None else TEXT[start:end]) == want


def test_offsets_of_a_sentence_are_kept():
    part = "Then they closed the meeting."
    at = TEXT.index(part)
    assert s.ground(TEXT, part.upper().replace(".", ""), (5000, 5001), (at + 5, at + 20)) == (at, at + len(part), "offset")


def test_alignment_is_the_nearest_stretch():
    rng = random.Random(3)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(200):
        quote, words = (rng.choices("abcd", k=rng.randrange(1, n)) for n in (7, 15))
        first, last, cost = s.align(quote, words)
        best = min(edits(quote, words[i:j]) for i in range(len(words) + 1) for j in range(i, len(words) + 1))
        assert cost == best == edits(quote, words[first:last])


def test_rows(spark):
    rows = [(1, TEXT, "closed the meeting", 0, None, None, None), (None, None, "x", None, None, None, None), (2, "", None, None, None, 0, 1), (3, "w " * 50000 + "the needle here. " + "w " * 50000, "the needle here", 100000, 100010, None, None)]
    got = {r.id: (r.how, r.span) for r in s.ground_quotes(spark.createDataFrame(rows, "id long, text string, quote string, low int, high int, start int, end int")).collect()}
    assert got == {1: ("exact", "closed the meeting"), None: ("span_unresolved", None), 2: ("missing_text", None), 3: ("exact", "the needle here")}
