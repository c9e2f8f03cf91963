import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, fp int, term string, shard int"

# Words that share nothing, so that a text is like no other by chance.
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ra", "si", "to", "vu") for c in ("b", "d", "g", "z")]


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


def rows(texts):
    """Documents with columns that clash with names the operators use."""
    return [(i, t, "en", "s", len(t or ""), "x", 1, "y", 2) for i, t in texts]


@pytest.fixture(scope="session")
def make(spark):
    def build(texts):
        return spark.createDataFrame(rows(texts), DOCS)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and long texts, ties, repeated rows and ids, clashing columns."""
    long_text = prose(5, 30_000)
    return make(
        [
            (1, prose(1, 120)), (2, None), (3, ""), (4, "  \n\t "), (5, prose(1, 120)), (5, prose(1, 120)),
            (None, prose(2, 60)), (None, None), (6, "é"), (7, long_text), (8, prose(3, 80) + "\n" + prose(1, 120)), (8, "two"),
        ]
    )


@pytest.fixture(scope="session")
def none(make):
    return make([])
