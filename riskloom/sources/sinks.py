"""Batch writers used inside ``foreachBatch``: repeatable, one folder per batch.

A batch overwrites its own ``batch_id`` folder, so a replay after a failure
leaves each row once.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import routing
from riskloom.sources import messages

log = logging.getLogger("riskloom.sinks")


def write_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet", by: str | None = None) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if by:
        writer = writer.partitionBy(by)
    writer.save(f"{path}/batch_id={batch_id}")


def drop_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove what a batch wrote, once no later batch reads it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_enriched(record: DataFrame, path: str, batch_id: int) -> None:
    """Enriched records as (key, value) messages keyed by customer."""
    write_batch(record.select("key", "value"), path, batch_id)


def write_messages(df: DataFrame, key: str, path: str, batch_id: int) -> None:
    """Predictions keyed by customer, decisions and feedback keyed by transaction."""
    write_batch(messages.encode(df, key), path, batch_id)


def write_routes(decisions: DataFrame, path: str, batch_id: int) -> None:
    """Three outputs from one decision batch; the caller keeps the batch cached."""
    for name, part in routing.split(decisions).items():
        write_messages(routing.PAYLOADS[name](part), "transactionId", f"{path}/{name}", batch_id)


def write_feedback(decisions: DataFrame, path: str, batch_id: int) -> None:
    write_messages(routing.feedback_record(decisions), "transactionId", f"{path}/analyst-feedback", batch_id)


def write_audit(tables: dict[str, DataFrame], path: str, batch_id: int,
                write: Callable[[DataFrame, str, int], None] | None = None) -> list[str]:
    """Append audit rows; a table that fails is logged and skipped, the stream goes on.

    ``write(df, table, batch_id)`` may send rows elsewhere, such as over JDBC.
    """
    failed = []
    for name, rows in tables.items():
        try:
            if write is None:
                write_batch(rows, f"{path}/{name}", batch_id)
            else:
                write(rows, name, batch_id)
        except Exception:  # noqa: BLE001 - the audit trail must not stop scoring
            log.exception("audit write failed: %s", name)
            failed.append(name)
    return failed


def jdbc_writer(url: str, properties: dict[str, str]) -> Callable[[DataFrame, str, int], None]:
    """Append over JDBC, skipping ids already stored (a replayed batch)."""

    def write(rows: DataFrame, table: str, batch_id: int) -> None:
        key = "transaction_id" if table == "transactions" else "id"
        stored = rows.sparkSession.read.jdbc(url, table, properties=properties).select(key)
        rows.join(stored, key, "left_anti").write.jdbc(url, table, mode="append", properties=properties)

    return write

