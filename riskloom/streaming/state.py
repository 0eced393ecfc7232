"""Streaming velocity: totals before state, so that a busy customer is never one task's rows.

What a batch adds is totalled by (customer, window, part of the window) before
anything is keyed by customer. Only those totals meet the kept counts; rows are
numbered inside their part and get the part's offset. The work of one task is
bounded by what a customer pays in one part, not by what they pay in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from riskloom.sources import sinks

LATEST = StructType([StructField("start", LongType()), StructField("n", LongType())])
COUNTS = "customerId string, start long, n long"


def _start_millis(span: str) -> Column:
    return F.unix_millis(F.window(F.col("timestamp").cast("timestamp"), span)["start"])


# --- running count, for foreachBatch ----------------------------------------

def stored_counts(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """Newest window and count of each customer, as the batch before this one left them."""
    if batch_id == 0:
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(f"{folder}/batch_id={batch_id - 1}")


def _part_totals(cut: DataFrame) -> DataFrame:
    """Rows a (customer, window, part): combined before the shuffle."""
    return cut.groupBy("customerId", "_start", "_part").agg(F.count(F.lit(1)).alias("_n"))


def number_rows(batch: DataFrame, known: DataFrame, size: str, part: str) -> DataFrame:
    """Append ``velocityCount``: the customer's rows so far in the window, going on from the kept counts.

    A row of a window older than the customer's kept one is late: it leaves the
    counter as it is and goes on with the kept count, so no transaction is lost.
    ``part`` is the length of the pieces that a window is cut into.
    """
    cut = batch.withColumns({"_start": _start_millis(size)}).withColumns({"_part": _start_millis(part)})
    kept = known.select(F.col("customerId").alias("_known"), F.col("start").alias("_seen"), F.col("n").alias("_count"))
    earlier = Window.partitionBy("customerId", "_start").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.when(F.col("_start") == F.col("_seen"), F.col("_count")).otherwise(0)
    offsets = _part_totals(cut).join(kept, F.col("customerId").eqNullSafe(F.col("_known")), "left").select(
        F.col("customerId").alias("_owner"), F.col("_start").alias("_window"), F.col("_part").alias("_piece"),
        F.when(F.col("_start") < F.col("_seen"), F.col("_count")).alias("_late"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + carried).alias("_before"))
    same = F.col("customerId").eqNullSafe(F.col("_owner")) & (F.col("_start") == F.col("_window")) & (F.col("_part") == F.col("_piece"))
    inside = Window.partitionBy("customerId", "_start", "_part").orderBy("timestamp", "transactionId")
    count = F.coalesce("_late", F.col("_before") + F.row_number().over(inside))
    return cut.join(offsets, same).withColumn("velocityCount", count).select(*batch.columns, "velocityCount")


def next_counts(batch: DataFrame, known: DataFrame, size: str, part: str, keep_seconds: int) -> DataFrame:
    """The kept counts after a batch. Customers whose window began ``keep_seconds`` before the newest one leave."""
    cut = batch.withColumns({"_start": _start_millis(size)}).withColumns({"_part": _start_millis(part)})
    added = _part_totals(cut).select("customerId", F.col("_start").alias("start"), F.col("_n").alias("n"))
    windows = added.unionByName(known).groupBy("customerId", "start").agg(F.sum("n").alias("n"))
    newest = windows.groupBy("customerId").agg(F.max("start").alias("start"), F.max_by("n", "start").alias("n"))
    limit = windows.agg(F.max("start") - keep_seconds * 1000).scalar()
    return newest.where(F.col("start") >= limit)


def number_batch(batch: DataFrame, batch_id: int, folder: str, size: str, part: str = "10 seconds",
                 keep_seconds: int = 7 * 86_400) -> DataFrame:
    """Number one micro-batch and keep the counts for the next.

    Counts are one small row a customer, written once a batch; a batch reads
    what its predecessor left, so a replay numbers its rows as the first try
    did. ``keep_seconds`` must be longer than a window; a customer silent for
    longer starts anew.
    """
    known = stored_counts(batch.sparkSession, folder, batch_id)
    sinks.write_batch(next_counts(batch, known, size, part, keep_seconds), folder, batch_id)
    sinks.drop_batch(batch.sparkSession, folder, batch_id - 2)
    return number_rows(batch, known, size, part)


# --- latest count, as state ---------------------------------------------------

def _window_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a (customer, window) of each Arrow batch: what a hot customer sends is a few totals."""
    for batch in batches:
        totals = pa.Table.from_batches([batch]).group_by(["customerId", "startMillis"]).aggregate([([], "count_all")])
        yield from totals.rename_columns(["customerId", "startMillis", "n"]).to_batches()


class LatestCount(StatefulProcessor):
    """Last window count per customer; an old count stays until the next transaction."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", LATEST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, n = self.latest.get() if self.latest.exists() else (None, 0)
        for totals in rows:
            for window, added in zip(totals["startMillis"].tolist(), totals["n"].tolist()):
                if start is None or window > start:
                    start, n = window, added
                elif window == start:
                    n += added
        self.latest.update((start, n))
        yield pd.DataFrame({"customerId": [key[0]], "velocityCount": [n]})

    def close(self) -> None:
        pass


def latest_velocity(txn: DataFrame, size: str) -> DataFrame:
    """Streaming form of the last-wins count per customer (update mode)."""
    windows = txn.select("customerId", _start_millis(size).alias("startMillis"))
    totals = windows.mapInArrow(_window_totals, "customerId string, startMillis long, n long")
    return totals.groupBy("customerId").transformWithStateInPandas(
        LatestCount(), "customerId string, velocityCount long", "Update", "None")
