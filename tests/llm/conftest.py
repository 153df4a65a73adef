import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, spans string, copy long, page long, run int, size string, span string, node string, gram string, doc string, m string, s string, first string, key string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source); the further columns have names that operators use inside."""

    def build(rows):
        full = [(i, t, lang, src, None if t is None else len(t), "x", None, 5, 6, 7, *"abcdefghi") for i, t, lang, src in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def corpus():
    """Awkward rows: nulls, empty and blank texts, copies, near copies, repeated rows, shared passages, long and non-ASCII texts."""
    rng = random.Random(5)
    words = ["the", "of", "and", "thé", "ñandú", "Straße", "日本", "x1", "don't", "we're", "a,", "B.", "zz", "###", "!!"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, other = text(60), text(45)
    long = "\n".join(text(30) for _ in range(60))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "word", "en", None), (5, "WORD", "en", "b"), (6, "Word", "de", "b")]
    rows += [(10 + k, f"{text(12)} {passage} {text(9)}", "en", "a") for k in range(4)]
    rows += [(20 + k, f"{text(20)}\n{other}\n{other}", "de", "b") for k in range(3)]
    rows += [(30, long, "fr", "c"), (31, long, "fr", "c"), (32, long.replace("zz", "qq", 1), "fr", "c"), (32, long.replace("zz", "qq", 1), "fr", "c")]
    rows += [(40, "ab" * 400, "en", "a"), (41, "ab" * 300, "en", "a"), (42, "é" * 150, "es", "a")]
    rows += [(50 + k, text(rng.randint(0, 40)), rng.choice(["en", "de", None]), rng.choice("abc")) for k in range(40)]
    return rows
