import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, near copies, and a clashing extra column."""
    words = [f"w{i % 97}x{i}" for i in range(400)]
    base = " ".join(words)
    near = " ".join([*words[:200], "other", *words[201:]])
    long = " ".join(f"long{i % 4999}" for i in range(60_000))
    rows = [
        (0, base, "en"), (1, base, "en"), (2, near, "fr"), (3, None, "en"), (4, "", "de"), (5, "  \n\t ", "en"), (6, "one two three", "en"), (7, "one two three", "es"),
        (8, long, "en"), (9, " ".join(words[100:160]), "en"), (9, " ".join(words[100:160]), "en"), (11, "ÀÉ ß " * 30, "fr"), (12, base.upper(), "en"), (None, base, "en"), (14, "x" * 3000, "en"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, cls string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, cls string")


def vocabulary(name: str) -> str:
    P = pytest.importorskip("public_tokenizers")
    return P.path(name)
