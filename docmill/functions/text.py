"""Text functions as columns, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Lower case with ss for sharp s, white space collapsed and trimmed: the form that search compares."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "(?U)\\s+", " "))


def tokens(text: Column) -> Column:
    """The runs of letters and digits of the normalised text."""
    return F.regexp_extract_all(normalized(text), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))


def trigrams(text: Column) -> Column:
    """The distinct character trigrams of the normalised text; a shorter text is its own only one, an empty one has none."""
    n = normalized(text)
    # a look-ahead takes one pass; substring(n, i, 3) would count from the start for every i
    several = F.array_distinct(F.regexp_extract_all(n, F.lit("(?s)(?=(.{3}))"), F.lit(1)))
    return F.when(F.length(n) >= 3, several).when(F.length(n) > 0, F.array(n)).otherwise(F.array().cast("array<string>"))


def overlap(a: Column, b: Column) -> Column:
    """Shared values over the size of the larger set; 0 for two empty ones."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), F.lit(0)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all values; 1 for two empty sets."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(1.0))


def cleaned_lines(text: Column) -> Column:
    """Spaces and tabs collapsed, lines trimmed, empty lines and carriage returns gone."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n", -1), lambda x: F.trim(F.regexp_replace(x, "[ \\t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def cosine(a: Column, b: Column) -> Column:
    """0 where the sizes differ or a norm is 0."""
    a, b = (F.transform(x, lambda v: v.cast("double")) for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def snippet(text: Column, term: Column, before: int = 73, after: int = 110) -> Column:
    """The text around the first place of term whatever the case, with marks where it was cut; its head if there is none."""
    n = F.length(text)
    at = F.instr(F.lower(text), F.lower(term))
    start = F.when(at > 0, F.greatest(at - before, F.lit(1))).otherwise(1)
    end = F.least(F.when(at > 0, at + after).otherwise(before + after), n + 1)
    return F.concat(F.when(start > 1, "...").otherwise(""), F.trim(F.substring(text, start, end - start)), F.when(end <= n, "...").otherwise(""))
