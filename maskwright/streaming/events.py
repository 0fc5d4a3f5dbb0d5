"""The scan over arriving files, and logs of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import detectors as D
from ..operators import findings as G


def tail(events: DataFrame, most: int) -> DataFrame:
    """The last events by id."""
    return events.orderBy(F.desc("event_id")).limit(most)


def since(events: DataFrame, cursor: int) -> DataFrame:
    """Events after a cursor, in order."""
    return events.where(F.col("event_id") > cursor).orderBy("event_id")


def progress(events: DataFrame) -> DataFrame:
    """Running counts and sums of each user."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("seen", F.count(F.lit(1)).over(w)).withColumn("total", F.sum("value").over(w))


def scan_stream(spark: SparkSession, folder: str, schema: str = "path string, text string", **how):
    """Detections of parquet files as they arrive: the same narrow plan as in batch."""
    return D.detect(spark.readStream.schema(schema).parquet(folder), list(D.BUILT_IN), **how)


def findings_sink(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str = "path string, text string"):
    """A query that writes canonical findings of each batch of files. A file is whole in its batch, so no state is kept."""
    docs = spark.readStream.schema(schema).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        found = G.consolidate(D.detect(batch, list(D.BUILT_IN)))
        G.public(found).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
