"""Activity of a stream of dated rows in windows: an extension, as the reference domain has batches only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.session import shared_dir


def windowed_counts(rows: DataFrame, ts: str, kind: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, kind, cnt) of each window; works on streams, where rows later than late may be left out, and on batches."""
    timed = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return timed.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), kind, "cnt")


def drained(counts: DataFrame, name: str) -> DataFrame:
    """Run a stream of aggregates over all that has arrived and read the last count of each window and kind.

    Each batch writes the windows that it changed, by the batch's number, so that a batch that is run again after a
    failure replaces its own rows only; the state of windows older than the watermark is dropped. The last batch that
    names a window has its count.
    """
    spark, path = counts.sparkSession, shared_dir(counts.sparkSession, name)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={n}")

    # An empty state first, so that a stream without rows reads as an empty table.
    write(spark.createDataFrame([], counts.schema), -1)
    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    keys = [c for c in counts.columns if c != "cnt"]
    return spark.read.parquet(f"{path}/data").groupBy(*keys).agg(F.max_by("cnt", "batch").alias("cnt"))
