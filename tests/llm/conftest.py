"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing column names."""

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(60_000))

#: Names that the operators use for their own columns, or might.
CLASHING = ("_id", "_text", "text_", "score", "spans", "fingerprint", "start", "component", "bucket", "file")


@pytest.fixture(scope="session")
def awkward(spark):
    """doc_id, text, lang, source, n_chars and clashing columns; a null id, null and empty texts, a repeated row."""
    texts = [None, "", " \t\n", "one", "two words", "a b c d e f g", LONG, "Ünïcode ÄÖ ñandú 漢字  x", "same text here now",
             "same text here now", "\x00\x1f odd", "trailing space ", "İstanbul K ſ"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id", None, None, 5), (2 ** 40, "far id", "en", "s", 6)]
    rows = [(*r, *("x" for _ in CLASHING)) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
