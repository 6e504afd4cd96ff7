"""Small inputs shared by the tests: nulls, empty texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, component_id int, shard string, score string, n_words string"


def frame(spark, rows):
    """documents with extra columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x", 7, "y", "z", "w") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=40):
    """Random texts with copies, near copies, shared lines and passages, and odd cases."""
    rng = random.Random(seed)
    shared = [words(rng, 45) for _ in range(3)]
    rows = []
    for i in range(n):
        body = words(rng, rng.choice([3, 30, 120]))
        if i % 3 == 0:
            body = f"{body} {rng.choice(shared)} {words(rng, 25)}"
        if i % 5 == 0 and rows:
            body = rng.choice(rows)[1] or ""
        if i % 7 == 0:
            body += "\n  Common LINE \nothers " + str(i)
        if i % 8 == 1 and rows:
            parts = (rng.choice(rows)[1] or "a b c").split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            body = " ".join(parts)
        rows.append((i * 3, body))
    rows += [(1000, None), (1001, ""), (1002, ""), (1003, " \n\t"), (1004, "one"), (1005, "é ü 日本 " * 30), (1006, "x " * 200), (None, words(rng, 60))]
    rows.append(rows[4])  # a repeated row
    return rows
