import pytest

CLASH = ["score", "key", "keys", "fp", "row", "body", "bucket", "spans", "h", "next", "rank", "length", "task", "text_", "rules", "low", "block", "items", "predicted", "cells", "train", "__key", "__rules", "__body", "__spans", "__id", "__h", "__fp", "__row", "__score", "r", "k1", "k2", "masked"]


@pytest.fixture(scope="session")
def prepared(spark):
    from tessera.llm.common import prepare

    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def odd(prepared):
    """Nulls in any column, empty and long texts, repeated rows, shared and null ids, and clashing extra columns."""
    long = "word another. " * 20_000
    rows = [
        (1, "Some text here.\nAnd a second line.", "en"), (1, "Some text here.\nAnd a second line.", "en"), (2, None, None), (3, "", "en"), (None, "an id is missing", "en"),
        (None, None, None), (4, long, "en"), (5, "  \n\t ", None), (4, "shares an id", "de"), (6, "ünïcödé 日本語 \U0001f600 text", "fr"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return prepared.createDataFrame([(*r, None, None if r[1] is None else len(r[1]), *["x"] * len(CLASH)) for r in rows], schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(prepared):
    rows = [(k, k % 2, (k + 1) % 2) for k in range(100, 140)] + [(None, 1, 1), (100, None, None), (101, 1, 0)]
    return prepared.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(prepared):
    return prepared.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
