import pytest


@pytest.fixture
def table(spark):
    """A documents table with clashing extra columns, in several partitions."""

    def make(rows, ddl="doc_id long, text string"):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame(rows, ddl).repartition(3)
        extra = {c: F.lit("x") for c in ("n", "token", "digest", "words", "kept", "hash", "size", "id")}
        return frame.withColumns({k: v for k, v in extra.items() if k not in frame.columns})

    return make
