"""Bound-certified best-fit packing of token sequences.

Documents become pieces of at most ``CAPACITY`` tokens. Full pieces are
sequences already. The rest is dealt to partitions by a hash; each is packed by
best-fit decreasing and compared with lower bounds from dual feasible functions
(no packing can use fewer sequences). Where a partition uses more than its
bound, its pieces are exchanged: all such partitions are dealt anew into half
as many and packed again, and the new packing is taken if it needs fewer
sequences. At the end the emptiest sequence of each partition, at most one a
partition, is opened and packed once more in groups that stay small.

Defined results: a null text is an empty one, which is the end token alone;
repeated rows are packed as often as they occur; no rows give no sequences.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import claim, kept, map_rows
from riskloom.llm.tokens import chunks

CAPACITY = 2048
END_TOKEN = 0
#: Pieces dealt to one partition on average.
PARTITION_PIECES = 20_000
#: Chunks whose ids a worker remembers (memory only).
KNOWN_CHUNKS = 900_000
#: How often partitions above their bound are dealt anew.
ROUNDS = 4


class TokenBytes:
    """Token ids of texts as 32-bit numbers in machine order (little-endian here), from the library, remembered by chunk."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.most_known = KNOWN_CHUNKS
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {"": b""}

    def _pack(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if any(s in t for s in self.special) else chunks(t) for t in texts]
        if len(self.known) > self.most_known:
            self.forget()
        known = self.known
        missing = list(set(chain.from_iterable(c for c in cut if c is not None)).difference(known))
        for at in range(0, len(missing), 2_000):
            part = missing[at:at + 2_000]
            known.update(zip(part, self._pack(part)))
        return [b"".join(map(known.__getitem__, c)) if c is not None else self._pack([t])[0] for c, t in zip(cut, texts)]


@lru_cache(maxsize=1)
def token_bytes(path: str) -> TokenBytes:
    """One per worker process and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it has
    return TokenBytes(path)


def cuts(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; what does not fill a piece comes first."""
    first = size % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, size, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False,
           known_chunks: int = KNOWN_CHUNKS) -> DataFrame:
    """doc_id, copy (numbers repeated ids), piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    schema = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    end = np.array([END_TOKEN], "<u4").tobytes()

    def work(batches):
        claim(token_bytes(tokenizer))
        token_bytes(tokenizer).most_known = known_chunks
        encode = token_bytes(tokenizer).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 250):  # cut texts are many small strings
                part = batch.slice(at, 250)
                rows = []
                for doc, copy, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                          encode([t or "" for t in part.column(2).to_pylist()])):
                    ids += end
                    for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        own = ids[4 * start:4 * (start + length)]
                        rows.append((doc, copy, k, start, length, zlib.crc32(own))
                                    + ((np.frombuffer(own, "<u4").tolist(),) if with_ids else ()))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in schema.split(", ")])

    read = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("copy"), "text")
    return map_rows(read, work, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of each length, and the bins used."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = used = 0  # rooms: bit r is set if a bin with room r is open
    for at in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[at])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, number = capacity, used
            used += 1
        bins[at], offsets[at] = number, capacity - room
        room -= size
        if room:
            open_bins[room].append(number)
            rooms |= 1 << room
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of several dual feasible functions: no packing has fewer bins.

    For each threshold t up to half the capacity, sizes above capacity - t count
    as full and sizes below t as nothing; and the staircase functions of Fekete
    and Schepers for small divisors.
    """
    if not len(lengths):
        return 0
    many = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    mass, count = np.cumsum(many * sizes), np.cumsum(many)
    t = np.arange(0, capacity // 2 + 1)
    below = np.where(t > 0, mass[np.maximum(t - 1, 0)], 0)
    total = (count[-1] - count[capacity - t]) * capacity + mass[capacity - t] - below
    best = int(-(-total.max() // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # times k, over capacity
        best = max(best, int(-(-(many * value).sum() // (capacity * k))))
    return best


def _pack_group(capacity: int):
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "copy", "piece"], ascending=[False, True, True], kind="stable")
        lengths = frame["length"].to_numpy()
        bins, offsets, used = best_fit(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used)
        return frame.assign(bin=bins, offset=offsets, fill=fill[bins].astype(np.int64), used=used,
                            bound=lower_bound(lengths, capacity))

    return work


_KEYS = ["copy", "piece"]
_PACKED = ("doc_id string, copy long, piece int, start long, length long, ids_crc32 long, grp long, bin long, offset long, "
           "fill long, used long, bound long")


def _packed(rows: DataFrame, groups: int, seed: int, capacity: int) -> DataFrame:
    dealt = rows.select(F.col("doc_id").cast("string"), *_KEYS, "start", "length", "ids_crc32").withColumn(
        "grp", F.pmod(F.xxhash64(*_KEYS, F.lit(seed)), F.lit(groups)))
    return kept(dealt.groupBy("grp").applyInPandas(_pack_group(capacity), _PACKED))


def _totals(packed: DataFrame) -> tuple[int, int]:
    """Sequences used and the sum of the partitions' bounds."""
    row = packed.groupBy("grp").agg(F.first("used").alias("used"), F.first("bound").alias("bound")).agg(
        F.sum("used").alias("used"), F.sum("bound").alias("bound")).first()
    return row["used"] or 0, row["bound"] or 0


def pack(cut: DataFrame, capacity: int = CAPACITY, per_partition: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for pieces as ``pieces`` gives them."""
    full = cut.filter(F.col("length") == capacity)
    loose = cut.filter(F.col("length") < capacity)
    groups = max(1, -(-loose.count() // per_partition))
    done, settled = [], _packed(loose, groups, 0, capacity)
    for turn in range(1, rounds + 1):
        gaps = settled.filter("used > bound")
        used, bound = _totals(gaps)
        if used == bound or groups == 1:
            break
        groups = max(1, groups // 2)
        again = _packed(gaps, groups, turn, capacity)
        if _totals(again)[0] < used:
            done.append((turn, settled.filter("used <= bound")))
            settled = again
    done.append((0, settled))
    packed = kept(_union(done))
    # The emptiest sequence of each partition: those of up to per_partition partitions meet in one group.
    emptiest = packed.groupBy("turn", "grp").agg(F.min(F.struct("fill", "bin")).alias("low")).select(
        F.col("turn").alias("_turn"), F.col("grp").alias("_grp"), F.col("low.bin").alias("_bin"))
    emptiest = kept(emptiest)
    match = (F.col("turn") == F.col("_turn")) & (F.col("grp") == F.col("_grp")) & (F.col("bin") == F.col("_bin"))
    opened = packed.join(emptiest, match, "left_semi")
    closed = packed.join(emptiest, match, "left_anti")
    last = _packed(opened, max(1, -(-emptiest.count() // per_partition)), rounds + 1, capacity)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "piece", "start", "length", "ids_crc32"]
    # 4 bits of round, 34 of partition, 25 of sequence; full pieces count down from -1.
    number = F.shiftleft(F.shiftleft(F.col("turn").cast("long"), 34) + F.col("grp"), 25) + F.col("bin")
    numbered = closed.select(*columns, number.alias("sequence_id"), "offset").unionByName(
        last.withColumn("turn", F.lit(rounds + 1)).select(*columns, number.alias("sequence_id"), "offset"))
    return numbered.unionByName(full.select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def _union(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    out = None
    for turn, part in parts:
        part = part.withColumn("turn", F.lit(turn))
        out = part if out is None else out.unionByName(part)
    return out


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, known_chunks: int = KNOWN_CHUNKS) -> DataFrame:
    """All documents as pieces placed in sequences; ``known_chunks`` bounds a worker's memory only."""
    return pack(kept(pieces(docs, tokenizer, capacity, known_chunks=known_chunks)), capacity)
