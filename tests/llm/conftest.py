import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text[, lang[, source]]) rows, with columns of clashing names beside them."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in ("size", "fp", "h", "key", "bucket", "row", "part", "rank", "score", "salt", "at", "ids", "rows"):
            df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return make


WORDS = "the of and to in was that it his for on are as with they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()


@pytest.fixture
def prose():
    import random

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + (r.choice("abcdef") if r.random() < 0.5 else "") for _ in range(n))

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty texts, repeated rows, ties, a long text and text beyond ASCII."""
    rows = [(1, None), (2, ""), (3, "one"), (4, "one two"), (5, "one two three four five six"), (5, "one two three four five six"), (6, "one two three four five six"), (None, "no id here"), (7, "Größe ñandú 日本語 😀 İ ſ K"), (8, "wörd " * 40_000), (9, " \t\n\r\x0b\x0c "), (10, "a b " * 1_000), (11, None, None, None)]
    return docs(rows)


@pytest.fixture
def empty(docs):
    return docs([(0, "x")]).limit(0)
