import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source) or texts; null columns elsewhere."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, source = r if isinstance(r, tuple) else (i, r, "s")
            full.append((doc_id, text, None, source, len(text) if text is not None else None))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in any column, empty and very long texts, repeated rows, and columns that clash with results."""
    long = "word " * 60_000 + "end@mail.example.com"
    rows = [(1, None, None), (2, "", "a"), (None, "some text here now ok", "b"), (3, long, None), (4, "a b", "a"), (4, "a b", "a"), (5, "\x00 \t\n", "b"), (6, "ünï ©ode 😀 text", "c")]
    df = make_docs(rows)
    clash = ["ids", "SPANS", "score", "features", "copies", "media", "digest", "signature", "license", "target", "kept", "predicted", "Media_Type", "n_tokens", "payload"]
    return df.withColumns({c: F.lit("x") for c in clash})
