import pytest

DOCUMENTS = "doc_id bigint, text string"


@pytest.fixture
def frame(spark):
    """Documents from texts, numbered from 1, with columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    def make(texts, ids=None):
        rows = list(zip(ids or range(1, len(texts) + 1), texts))
        made = spark.createDataFrame(rows, DOCUMENTS)
        for name in ("key", "pos", "rank", "n_tokens", "digest", "content", "markup", "distance", "prose"):
            made = made.withColumn(name, F.lit("clash"))
        return made

    return make


@pytest.fixture(scope="session")
def common(spark):
    words = "the of and to in a is that for it was on are as with be by at from or not this der die das und le la les de el los y en un une que".split()
    return spark.createDataFrame([("xx", w) for w in words] + [("xx", None)], "lang string, word string")
