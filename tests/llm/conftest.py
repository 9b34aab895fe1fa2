import pytest

from tidepanel.llm.common import table

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(4000)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source[, lang]]) rows, with clashing extra columns."""

    def make(rows, extra=True):
        full = [(*r, *("src0", "en")[len(r) - 2:]) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, source string, lang string")
        if extra:
            df = df.selectExpr("*", "1 AS n_words", "2 AS size", "3 AS keys", "4 AS n", "5 AS length", "6 AS y", "7 AS unit", "8 AS block")
        return df
    return make


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, SF, "documents")
