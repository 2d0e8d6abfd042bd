import pytest

from tessella.llm.shared import importable


@pytest.fixture(autouse=True)
def _workers_find_the_package(spark):
    importable(spark)


@pytest.fixture
def documents(spark):
    """Makes a table of documents from texts, with ids from 0 and columns that clash in name."""

    def make(texts, ids=None, sources=None):
        rows = [(i, t, s, "x", 1, 2) for i, t, s in zip(range(len(texts)) if ids is None else ids, texts, sources or ["a"] * len(texts))]
        return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, h long, n long")

    return make
