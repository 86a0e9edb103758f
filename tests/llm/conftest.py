import pytest

from ledgerlens.llm.common import tuned

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts: ids count from 0, source and language alternate."""

    def make(texts, ids=None):
        tuned(spark)
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, ["en", "fr"][n % 2], ["a", "b", None][n % 3], len(t or "")) for n, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, DOCS)

    return make
