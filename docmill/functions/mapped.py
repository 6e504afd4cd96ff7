"""Normal forms of texts that know where each of their characters comes from."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is left out, what counts as one quote, and the runs that count as one dash.
LEFT_OUT = regex.compile(r"[\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff]")
QUOTES = regex.compile(r"[\u2018\u2019\u201b\u2032\u05f3\u05f4`\u00b4\u02bc\u02bb\"']")
DASHES = regex.compile(r"--+|[\u2010-\u2015\u2212]+")


@lru_cache(maxsize=1 << 16)
def _plain(cluster: str) -> str:
    """A character with its marks in NFKC, without marks of direction and of no width."""
    return LEFT_OUT.sub("", unicodedata.normalize("NFKC", cluster))


@lru_cache(maxsize=1 << 16)
def _folded(plain: str) -> str:
    """Lower case, one form of quotes and dashes, blanks as spaces."""
    return regex.sub(r"\s", " ", DASHES.sub("-", QUOTES.sub("'", plain))).casefold()


#: Characters that are their own normal form but for their case, with single spaces between them; what may compose with a mark is left out.
SIMPLE = regex.compile(r"[0-9A-Za-z!#$%&()*+,./:;<=>?@\[\\\]^_{|}~]+(?: [0-9A-Za-z!#$%&()*+,./:;<=>?@\[\\\]^_{|}~]+){0,99}(?![^\x00-\x7f])")
CLUSTER = regex.compile(r"\X")


def _normal_parts(text: str) -> Iterator[tuple[str, Iterable[int]]]:
    """The normal form in parts, with the offset of each character; a last space may be too much."""
    before = ""  # the character before, if it was a dash
    blank = True  # the last character is a space, or there is none yet
    start = 0
    while start < len(text):
        if m := SIMPLE.match(text, start):
            yield m.group().lower(), range(start, m.end())
            before, blank = "", False
        else:
            m = CLUSTER.match(text, start)
            plain = _plain(m.group())
            if before and plain and DASHES.fullmatch(before + plain[0]):
                plain = plain[1:]  # one run with the dash before
            if plain:
                before = plain[-1] if plain[-1] == "-" or DASHES.fullmatch(plain[-1]) else ""
            for c in _folded(plain):
                if c != " " or not blank:
                    yield c, (start,)
                    blank = c == " "
        start = m.end()


def normal_form(text: str) -> tuple[str, np.ndarray]:
    """The normal form, and for each of its characters the offset in `text` of the character that it comes from, and behind the last
    one the length of the text. Runs of blanks are one space, those at both ends are gone, and runs of one kind of dash are one. It is
    the same as that of the whole text normalised at once: a character is folded together with the marks that compose with it."""
    out: list[str] = []
    at: list[int] = []
    for part, places in _normal_parts(text):
        out.append(part)
        at.extend(places)
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), np.array([*at, len(text)], np.int64)


def first_place(text: str, wanted: str) -> tuple[int, int] | None:
    """Where a normal form stands first in the normal form of a text, in offsets of the text; what comes after it is hardly read."""
    out: list[str] = []
    at: list[int] = []
    parts, more = _normal_parts(text), 1 << 10
    while True:
        whole = True
        for part, places in parts:
            out.append(part)
            at.extend(places)
            if len(at) >= more:
                whole = False
                break
        if (found := "".join(out).find(wanted)) >= 0:
            return source_span(at, text, found, found + len(wanted))
        if whole:
            return None
        more *= 2


def source_span(at: Sequence[int], text: str, start: int, end: int) -> tuple[int, int]:
    """The stretch of the text behind the characters start to end of its normal form, with the marks of the last one."""
    last = int(at[end - 1])
    return int(at[start]), CLUSTER.match(text, last).end()


def check_mentions(rows: DataFrame) -> DataFrame:
    """(id, verdict, found_start, found_end) of rows (id, text, mention, start, end): whether the mention stands at its offsets, literally
    (strict) or in its normal form (normalised); if not, or if the offsets are out of range, where its normal form stands first in the
    text, in offsets of the text (moved), or mismatch, out_of_range, empty."""

    def verdict(text: str, mention: str, start: int | None, end: int | None) -> tuple[str, int | None, int | None]:
        wanted, _ = normal_form(mention)
        if not wanted:
            return "empty", None, None
        inside = start is not None and end is not None and 0 <= start < end <= len(text)
        if inside and text[start:end] == mention:
            return "strict", start, end
        if inside and normal_form(text[start:end])[0] == wanted:
            return "normalised", start, end
        if (place := first_place(text, wanted)) is not None:
            return "moved", *place
        return ("mismatch" if inside else "out_of_range"), None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["id"], *verdict(r["text"] or "", r["mention"] or "", r["start"], r["end"])) for r in batch.to_pylist()]
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["id", "verdict", "found_start", "found_end"])

    named = rows.select(F.col("id").cast("long").alias("id"), "text", "mention", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    return named.mapInArrow(run, "id long, verdict string, found_start int, found_end int")
