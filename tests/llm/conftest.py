import pytest


@pytest.fixture
def frame(spark):
    """Rows as a table with clashing column names beside the wanted ones."""
    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        extra = {n: "x" for n in ("node", "name", "part", "id", "key", "_row", "component", "bucket", "w", "size")
                 if n not in df.columns}
        from pyspark.sql import functions as F
        return df.withColumns({n: F.lit(v) for n, v in extra.items()})
    return make
