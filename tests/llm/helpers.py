"""Small fixtures: rows with nulls in every column, empty and long texts, ties, repeats and clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, payload string, key string, n_tokens string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


def odd_rows(seed=1):
    """Near copies, exact copies, repeated ids, nulls, blanks, letters beyond ASCII, one very long text."""
    rng = random.Random(seed)
    base = words(rng, 120)
    other = words(rng, 90)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, " ".join(near)), (3, base), (4, other), (4, other), (5, None), (6, ""), (7, "  \n\t "), (8, "one two"), (9, "ONE Two"), (10, "日本語 テスト é ß 😀"),
        (None, base + " end"), (None, None), (11, words(rng, 30) + "\n" + other[:300] + "\n" + words(rng, 30)), (12, "word " * 3000), (13, words(rng, 20000)), (14, "x" * 5000), (4, "another text with the same id"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else "s", k, "b", None, "k", "n") for k, (i, t) in enumerate(rows)]


def odd_documents(spark, seed=1):
    return spark.createDataFrame(odd_rows(seed), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
