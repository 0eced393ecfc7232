"""What the operators share: reading tables, shipping the package, bounded memos, skew-safe joins."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.session import shared_folder, ship_package

#: Rows, and characters of them as JSON, up to which a table whose size was counted may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 64_000_000
#: Entries a worker's memo holds before it starts anew (memory only, never results).
MEMO_ENTRIES = 350_000
#: Rows, and bytes, of a batch sent to a Python worker at most; texts may be long. With larger batches the
#: native memory of an executor grew and stayed (memory only, never results).
BATCH_ROWS = 2_000
BATCH_BYTES = 1_000_000
#: Batches after which a lean worker returns freed memory.
GIVE_BACK = 32
#: Rows of a table that a scan holds at once; with texts, Spark's 4,096 fill arrays of tens of megabytes.
SCAN_ROWS = 1_024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the workers and bound the batches that are read and that they are given."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > SCAN_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)
    ship_package(spark)


def map_rows(df: DataFrame, work: Callable, schema: str, lean: bool = False) -> DataFrame:
    """``mapInArrow`` with the package on the workers.

    The cycle collector rests meanwhile: the work makes no cycles, and each
    collection would walk all that the memos hold. ``lean`` workers return
    freed memory while they work, which costs some time.
    """
    ship(df.sparkSession)

    def calm(batches):
        for number, batch in enumerate(batches):
            if number % GIVE_BACK == GIVE_BACK - 1:
                give_back()
            yield batch

    def run(batches):
        gc.disable()
        if lean:
            pa.set_memory_pool(pa.system_memory_pool())  # returns what is freed, unlike the default one
        try:
            yield from work(calm(batches) if lean else batches)
        finally:
            gc.enable()
            give_back()

    return df.mapInArrow(run, schema)


_scratch: list[list[str]] = []


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/riskloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``make`` gives, written; the tables it wrote and the rows it shuffled on the way are deleted."""
    _scratch.append([])
    try:
        df = make()
        path = f"{shared_folder(df.sparkSession)}/riskloom-{uuid.uuid4().hex}"
        df.write.parquet(path)
    finally:
        made = _scratch.pop()
    spark, schema = df.sparkSession, df.schema
    del df
    for old in made:
        location = spark._jvm.org.apache.hadoop.fs.Path(old)
        location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
    if _scratch:
        _scratch[-1].append(path)
    spark._jvm.System.gc()  # shuffle files stay until the driver finds that no frame needs them
    return spark.read.schema(schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast only where its rows are few and not wide, both as measured."""
    if df.count() > BROADCAST_ROWS:
        return df
    chars = df.agg(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0] or 0
    return F.broadcast(df) if chars <= BROADCAST_CHARS else df


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """doc_id and text of rows with an id; of rows with equal ids the smallest text."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(
        "doc_id is not null")
    again = kept(read.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again")))
    if again.isEmpty():
        return read
    same = F.col("doc_id") == F.col("_again")
    return read.join(small(again), same, "left_anti").union(
        read.join(small(again), same, "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))


def numbered(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """Rows with ``place``, their place in the group from 0, and ``members``, the rows of the group; written.

    Rows are dealt by ranges of (group, order), so a group of any size is
    spread; each range is counted, and a prefix over those counts, at most one
    a group and range, gives the place of its first row.
    """
    by = [*[F.asc_nulls_first(g) for g in groups], *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_number", F.monotonically_increasing_id())
    dealt = kept(dealt.withColumns({"_range": F.shiftright("_number", 33), "_row": F.col("_number").bitwiseAND((1 << 33) - 1)}))
    ranges = dealt.groupBy(*groups, "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = kept(ranges.select(
        *[F.col(g).alias(f"_of_{g}") for g in groups], F.col("_range").alias("_of"),
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_offset"), F.sum("_rows").over(whole).alias("members")))
    match = F.col("_range") == F.col("_of")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return dealt.join(small(offsets), match).select(*df.columns, (F.col("_row") + F.col("_offset")).alias("place"), "members")


def held_out(doc_id: Column) -> Column:
    """The fold kept away from learning: crc32 of the id's digits, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


_holders: list = []


def claim(holder) -> None:
    """Let only this holder's memos live on in the worker; those of operators that ran before are emptied."""
    before = [other for other in _holders if other is not holder]
    for other in before:
        other.forget()
    _holders[:] = [holder]
    if before:
        give_back()


def give_back() -> None:
    """Return freed memory to the system; allocators would keep it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Memo(dict):
    """Remembers ``work(key)``; emptied when full, so that its size is bounded."""

    def __init__(self, work: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.work, self.entries = work, entries

    def forget(self) -> None:
        self.clear()

    def __missing__(self, key):
        value = self.work(key)
        if len(self) >= self.entries:
            self.clear()
        self[key] = value
        return value


class WordTable:
    """Integer measures of words, remembered by word and summed per text with one gather.

    ``measure(word)`` gives a tuple of ``width`` integers. The table starts anew
    between batches once it is full; long words are measured but not remembered.
    """

    def __init__(self, measure: Callable, width: int, entries: int = MEMO_ENTRIES, longest: int = 64):
        self.measure, self.width, self.entries, self.longest = measure, width, entries, longest
        self.forget()

    def forget(self) -> None:
        self.rows = np.zeros((1024, self.width), np.int32)
        self.used = 0
        self.memo = _Index(self)

    def _add(self, word: str) -> int:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.used] = self.measure(word)
        self.used += 1
        return self.used - 1

    def totals(self, words: list[str]) -> np.ndarray:
        return self.gather(words).sum(axis=0, dtype=np.int64)

    def gather(self, words: list[str]) -> np.ndarray:
        """One row of measures per word; a measure fits in 31 bits."""
        if self.used >= self.entries:
            self.forget()
        index = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        return self.rows[index]


class _Index(dict):
    def __init__(self, table: WordTable):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> int:
        index = self.table._add(word)
        if len(word) <= self.table.longest:
            self[word] = index
        return index


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (last: intercept) by Newton steps with a ridge penalty; for bounded samples."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w = w + change
        if np.abs(change).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
