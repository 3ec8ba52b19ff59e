from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
#: Texts that every operator on documents has to take: null, empty, blank, no letters, repeated rows, a very long text,
#: one very long word, text beyond ASCII.
EDGES = [
    (900001, None), (900002, ""), (900003, " \n\t "), (900004, "12 34 !!"), (900005, "same row"), (900005, "same row"), (900006, "word of many " * 20000),
    (900007, "x" * 60000), (900008, "é中🎉 ß  a\x1cb  c\r\n\n"), (None, "no id here"), (900009, "same row"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows with columns whose names clash with those of results."""
    rows = [(i, t, "en", 0.5, True, "x", "y") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, kept boolean, ids string, spans string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)
