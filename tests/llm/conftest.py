import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (doc_id, text) rows."""
    def run(rows, extra=""):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", "s", len(t) if t is not None else None, *more) for i, t, *more in rows]
        return spark.createDataFrame(full, DOCS + (", " + extra if extra else ""))

    return run


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def edge():
    """Null, empty, blank, tied, repeated, very long and odd texts."""
    return [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (4, "one"), (None, "no id"), (5, "a b c d e f g h " * 3), (6, "word " * 30_000), (7, "x" * 200_000), (8, "é" * 50 + " 日本 \x00 \u2028 😀"), (9, "\n".join(["same line here"] * 5))]
