"""Normal forms with offsets: against whole-text normalisation, round trips, and mentions."""

import random
import unicodedata

import pytest
import regex

from docmill.functions import mapped as m


def whole(text):
    """The normal form without offsets."""
    t = m.LEFT_OUT.sub("", unicodedata.normalize("NFKC", text))
    return regex.sub(r"\s+", " ", m.DASHES.sub("-", m.QUOTES.sub("'", t))).strip().casefold()


ALPHABET = ["a", "B", "ß", "É", "é", "\u0301", " ", "\t", "\n", "\u00a0", "\u200f", "\ufeff", "\u2018", "\u05f4", "\u2013", "\u2014", "-", "-", "\ufb01", "\u2460", "\u1100\u1161", "가", "日", "½", "😀", "İ"]


def test_it_is_the_form_of_the_whole_text():
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choices(ALPHABET, k=rng.randrange(0, 25)))
        form, at = m.normal_form(text)
        assert form == whole(text), repr(text)
        assert len(at) == len(form) + 1 and at[-1] == len(text) and (at[1:] >= at[:-1]).all()


def test_every_span_can_be_found_again():
    rng = random.Random(8)
    plain = [c for c in ALPHABET if c not in ("́", "가")]
    for _ in range(300):
        text = "".join(rng.choices(plain, k=20))
        form, at = m.normal_form(text)
        if len(form) < 2:
            continue
        i = rng.randrange(len(form) - 1)
        j = rng.randrange(i + 1, len(form) + 1)
        a, b = m.source_span(at, text, i, j)
        assert form[i:j].strip() in whole(text[a:b]) or whole(text[a:b]) == ""


@pytest.mark.parametrize(
    "mention,start,end,want",
    [
        ("Hall", 5, 9, ("strict", 5, 9)),
        ("hall", 5, 9, ("normalised", 5, 9)),
        ("‘x-y’", 15, 20, ("normalised", 15, 20)),
        ("TOWN   hall", 0, 3, ("moved", 0, 9)),
        ("ve", 999, 1001, ("moved", 26, 28)),
        ("café", 21, 23, ("moved", 21, 25)),
        ("nothing", 0, 3, ("mismatch", None, None)),
        ("nothing", 5, 5, ("out_of_range", None, None)),
        ("nothing", None, 5, ("out_of_range", None, None)),
        (" ‏", 0, 3, ("empty", None, None)),
        (None, 0, 3, ("empty", None, None)),
    ],
)
def test_mentions(spark, mention, start, end, want):
    text = "Town Hall‏ sat 'x–y' café ve"
    rows = spark.createDataFrame([(1, text, mention, start, end, "clash")], "id long, text string, mention string, start int, end int, verdict string")
    r = m.check_mentions(rows).first()
    assert (r.verdict, r.found_start, r.found_end) == want


def test_odd_rows(spark):
    schema = "id long, text string, mention string, start int, end int"
    rows = [(None, None, "x", 0, 1), (2, "", "x", 0, 1), (3, "w " * 100000 + "needle", "NEEDLE", 0, 6), (3, "w", "w", 0, 1)]
    got = {(r.id, r.verdict, r.found_start) for r in m.check_mentions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(None, "out_of_range", None), (2, "out_of_range", None), (3, "moved", 200000), (3, "strict", 0)}
    assert m.check_mentions(spark.createDataFrame([], schema)).count() == 0


def test_runs_of_simple_characters_fold_like_single_ones():
    rng = random.Random(5)
    odd = [*ALPHABET, *"bZ09 .;'`\r", "  ", "\r\n", "--", "\u200d", "\u0600", "\U0001f1e9\U0001f1ea"]
    for _ in range(4000):
        text = "".join(rng.choice(odd) if rng.random() < 0.5 else rng.choice("ab Cd.") for _ in range(rng.randrange(40)))
        out, at = m.normal_form(text)
        starts = {x.start() for x in regex.finditer(r"\X", text)}
        assert out == whole(text) and at.tolist() == sorted(at.tolist()) and set(at[:-1].tolist()) <= starts, text
        if out:
            i = rng.randrange(len(out))
            if wanted := out[i : i + 3].strip():
                found = out.find(wanted)
                assert m.first_place(text, wanted) == m.source_span(at, text, found, found + len(wanted))
        assert m.first_place(text, "qqqq") is None


def test_what_comes_after_the_first_place_is_hardly_read(monkeypatch):
    read, folded = [], m._folded
    monkeypatch.setattr(m, "_folded", lambda plain: read.append(plain) or folded(plain))
    text = "é à " * 500 + "the Needlé here " + "é à " * 50000
    assert m.first_place(text, m.normal_form("needlÉ")[0]) == (2004, 2010)
    assert len(read) < 20000
