import pytest
from pyspark.sql import SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(rows of (doc_id, text[, lang[, source]]), spare=True) -> DataFrame in 3 partitions."""

    def make(rows, spare=True):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if spare:
            # columns that clash with names the operators use
            from pyspark.sql import functions as F

            for name in ("size", "shard", "key", "words", "start", "score", "kept", "features", "part", "offset", "root", "label", "doc_hash",
                         "bad_id", "gone_id", "mixed_id", "copies", "row", "col"):
                df = df.withColumn(name, F.lit("own"))
        return df.repartition(3)

    return make
