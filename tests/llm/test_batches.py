import pyarrow as pa
from pyspark.sql import functions as F

from knotwork.llm.common import BATCH_BYTES, small_batches


def test_long_texts_come_in_bounded_batches(spark):
    """Batches end at a number of bytes too, also where the session had raised that bound."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1g")
    small_batches(spark)
    long = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    found = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 100 and max(r["size"] for r in found) <= BATCH_BYTES + (2 << 20)
