"""Decisions in texts, as one chain: lines, items, votes, duplicates, split and merged spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.spans import MergeRules, fold_spans, signature
from docmill.sources.tables import table


@dataclass(frozen=True)
class Words:
    """The words that tell decisions. The defaults are fixed values: one language's section heads, verbs, votes and connectors."""

    sections: tuple[str, ...] = ("סיכום והחלטות", "החלטות", "נושא ההחלטה", "תוכן ההחלטה", "תחילת תוקף")
    table_heads: tuple[str, ...] = ("נושא ההחלטה", "תוכן ההחלטה", "תחילת תוקף")
    phrases: tuple[str, ...] = ("הוחלט", "מחליטים", "מאשרים", "אושר", "החלטה")
    firm: tuple[str, ...] = ("הוחלט", "אושר", "מאשרים")
    headings: tuple[str, ...] = ("סעיף", "פרק", "נושא", "סיכום", "החלטות")
    unanimous: tuple[str, ...] = ("פה אחד", "אושר פה אחד", "התקבל פה אחד")
    votes: tuple[str, str, str] = ("בעד", "נגד", "נמנע(?:ים)?")
    script: str = r"\p{Hebrew}"
    number_word: str = r"החלטה\s*(?:מס['\"]?|מספר)?"
    splits: tuple[tuple[str, int], ...] = (("כמו כן מאשרים", 7), ("וכן מאשרים", 0), ("בנוסף מאשרים", 0))
    rules: MergeRules = field(default_factory=MergeRules)

    @cached_property
    def patterns(self) -> dict[str, regex.Pattern]:
        yes, no, none = self.votes
        gap = "[^0-9]{0,12}"
        return {
            "slash": regex.compile(rf"{yes}\s*/\s*{no}\s*/\s*{none}\s*[:\-]?\s*(\d+)\s*/\s*(\d+)\s*/\s*(\d+)"),
            "counts": regex.compile(rf"{yes}{gap}(\d+){gap}{no}{gap}(\d+)(?:{gap}{none}{gap}(\d+))?"),
            "numbered": regex.compile(r"(\d{1,3})[.)-]\s*(.+)"),
            "loose": regex.compile(rf"\.?\s*(\d{{1,3}})\s*(.*{self.script}.*)"),
            "heading": regex.compile(rf"({'|'.join(self.headings)})\b"),
            "number": regex.compile(rf"{self.number_word}\s*([0-9]{{1,4}}[/-]?[0-9]{{0,4}})"),
        }


def plain(text: str) -> str:
    return regex.sub(r"\s+", " ", text).strip()


def any_in(words: tuple[str, ...], text: str) -> bool:
    return any(w in text for w in words)


def parse_vote(text: str, words: Words = Words()) -> tuple[int | None, int | None, int | None, bool | None, bool, float, str] | None:
    """(for, against, abstained, unanimous, uncertain, confidence, pattern): counts with slashes, counts with words, a phrase, or a mere
    mention; None without any."""
    text = plain(text)
    for name, sure in (("slash", 0.96), ("counts", 0.94)):
        if m := words.patterns[name].search(text):
            yes, no, none = (None if g is None else int(g) for g in m.groups())
            return yes, no, none, False, False, sure, name
    if any_in(words.unanimous, text):
        return None, None, None, True, False, 0.92, "unanimous_phrase"
    if regex.search("|".join(words.votes), text):
        return None, None, None, None, True, 0.4, "uncertain"
    return None


@dataclass
class Item:
    start: int
    end: int
    text: str
    number: str | None
    agenda: str | None
    confidence: float
    vote: tuple | None


def _lines(text: str) -> list[tuple[int, str]]:
    at, out = 0, []
    for line in text.split("\n"):
        out.append((at, line))
        at += len(line) + 1
    return out


def _numbered(line: str, words: Words, loose: bool) -> tuple[str | None, str]:
    for name in ("numbered", *(["loose"] if loose else [])):
        if m := words.patterns[name].fullmatch(line):
            return m[1], m[2].strip()
    return None, line


def _decides(text: str, words: Words, in_section: bool, numbered: bool) -> bool:
    """Whether a line is a decision: not a heading; a table row of a section, a verb, a long numbered line of a section, a vote there."""
    text = plain(text)
    if not 0 < len(text) <= 1000 or text in words.sections or any_in(words.table_heads, text):
        return False
    row = "|" in text and (in_section or words.rules.heading in text)
    return row or any_in(words.phrases, text) or in_section and (numbered and len(text) > 25 or words.votes[0] in text or any_in(words.unanimous, text))


def _begins(line: str, words: Words) -> bool:
    """Whether a line can't go on with the item before it."""
    return not line or _numbered(line, words, True)[0] is not None or bool(words.patterns["heading"].match(line)) or any_in(words.sections, line)


def items(text: str, words: Words = Words()) -> list[Item]:
    """The decisions of a text: from the first section heading on, if there is one, each line that decides with up to three lines that go
    on with it; of items with one signature the first."""
    lines = _lines(text)
    section = next((i for i, (_, x) in enumerate(lines) if any_in(words.sections, plain(x))), None)
    found: dict[str, Item] = {}
    i = section or 0
    while i < len(lines):
        at, line = lines[i]
        number, said = _numbered(line.strip(), words, section is not None)
        if not _decides(said, words, section is not None, number is not None):
            i += 1
            continue
        last = i
        while last + 1 < len(lines) and last - i < 3 and not _begins(lines[last + 1][1].strip(), words):
            last += 1
        whole = " ".join([said, *(x.strip() for _, x in lines[i + 1 : last + 1])]).strip()
        end = lines[last][0] + len(lines[last][1])
        i = last + 1
        if len(whole) < 12:
            continue
        vote = parse_vote(whole, words)
        marks = (section is not None, 0.2), (number is not None, 0.15), (any_in(words.firm, whole), 0.15), ("|" in whole, 0.1), (vote is not None, 0.05)
        cells = [c.strip() for c in plain(whole).split("|") if c.strip()]
        agenda, said = (cells[0][:120], max(cells[1:], key=len)) if "|" in whole and len(cells) > 1 else (None, plain(whole))
        if number is None and (m := words.patterns["number"].search(whole)):
            number = m[1]
        item = Item(at, end, said, number, agenda, min(1.0, round(0.45 + sum(w for x, w in marks if x), 4)), vote)
        if key := signature(said):
            found.setdefault(key, item)
    return list(found.values())


def split(item: Item, text: str, words: Words) -> list[Item]:
    """An item that approves twice, as two: cut before the second approval, if either part has 16 characters or more."""
    whole = text[item.start : item.end]
    for marker, skip in words.splits:
        at = whole.find(marker)
        if at > 24:
            cuts = [(item.start, item.start + at), (item.start + at + skip, item.end)]
            parts = [Item(a, b, text[a:b].strip(), item.number, item.agenda, item.confidence, item.vote) for a, b in cuts if len(text[a:b].strip()) >= 16]
            return parts or [item]
    return [item]


def decisions_in(text: str, words: Words = Words()) -> list[Item]:
    """The whole chain: items, splits, first of each signature, neighbours merged. A merged one has the first number, agenda item and vote
    of its parts and their highest confidence."""
    first: dict[str, Item] = {}
    for item in items(text, words):
        for part in split(item, text, words):
            if key := signature(part.text):
                first.setdefault(key, part)
    parts = sorted(first.values(), key=lambda x: (x.start, x.end))
    merged = fold_spans(text, [{"start": p.start, "end": p.end, "number": p.number, "confidence": p.confidence} for p in parts], words.rules)
    out, at = [], 0
    for start, end, number, confidence, n in merged:
        own = parts[at : at + n]
        at += n
        said = own[0].text if n == 1 else text[start:end].strip()
        out.append(Item(start, end, said, number, next((p.agenda for p in own if p.agenda), None), confidence, next((p.vote for p in own if p.vote), None)))
    return out


ROW = "doc_id long, nth long, start long, end long, number string, agenda string, confidence double, yes int, no int, abstained int, unanimous boolean, uncertain boolean, pattern string, text string"


def find_decisions(docs: DataFrame, words: Words = Words()) -> DataFrame:
    """The decisions of docs (doc_id, text), numbered in each text. Null and empty texts have none; rows that repeat a doc_id are texts of
    their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ROW.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
        types = [kinds[c.split()[1]] for c in ROW.split(", ")]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for k, x in enumerate(decisions_in(text or "", words)):
                    yes, no, none, unanimous, uncertain, _, pattern = x.vote or (None,) * 7
                    rows.append((doc, k, x.start, x.end, x.number, x.agenda, x.confidence, yes, no, none, unanimous, uncertain, pattern, x.text))
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROW)


#: Words of the tables' licence lines: these are what their texts have in the place of decisions.
LICENCES = Words(
    sections=("rights reserved",), table_heads=("|---",), phrases=("licensed", "Copyright", "reserved", "License"), firm=("licensed", "reserved"), headings=("Copyright",),
    unanimous=("All rights",), votes=("version", "under", "the"), script=r"\p{Latin}", number_word=r"version", splits=(("licensed under", 0),), rules=MergeRules(connectors=("also", "and the"), heading="License"),
)


def decision_chain(spark: SparkSession, d: str) -> DataFrame:
    """The chain over all documents, with the words of their licence lines."""
    found = find_decisions(table(spark, d, "documents"), LICENCES)
    return found.select("doc_id", "nth", F.col("start").alias("start_"), F.col("end").alias("end_"), F.coalesce("number", F.lit("")).alias("number"), F.coalesce("agenda", F.lit("")).alias("agenda"), "confidence", F.coalesce("pattern", F.lit("")).alias("vote"), F.md5("text").alias("text_md5"))


QUERIES = {"decision_chain": decision_chain}
ORACLE_SQL: dict[str, str] = {}
