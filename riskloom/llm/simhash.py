"""SimHash near duplicates by deletion-variant signatures.

Fingerprints within ``DISTANCE`` bits, cut into ``DISTANCE // 2 + 1`` segments,
agree in one segment up to one bit. Each distinct fingerprint is stored under
its segments and looked up under each segment and each segment with one set bit
cleared (a wildcard on that bit), so that an equality join finds every such
pair from the side that has the bit; the pairs are verified on all 64 bits.

Equal fingerprints are one row before the index. A segment value that more than
``CROWD`` distinct fingerprints share is not paired out: its fingerprints are
indexed under all variants with ``DISTANCE`` wildcards over the whole
fingerprint instead. All that share such a variant are within the distance, so
each is linked to the smallest of them: as exact, and linear in the group.

Defined results: null, empty and blank texts have fingerprint zero and link like
any other; rows without an id get the component of their fingerprint's rows
with ids (null if there are none); repeated rows give repeated results.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import kept, map_rows, small
from riskloom.llm.components import components

SHINGLE = 3
DISTANCE = 2
BITS = 64
CROWD = 1000
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
BLOCK = 1 << 16


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Word runs of a text, repeats included; words are cut at ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined] if words else []
    ends = [at + k for k, at in enumerate(accumulate(map(len, words)))]
    starts = [0, *(at + 1 for at in ends[:-1])]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1:])]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, 42) for s in shingles(text, size)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at:at + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and the 64 bits as a signed long, one row per input row."""

    def work(batches):
        for batch in batches:
            bits = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["doc_id", "fp"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, fp long")


def _segment(fp: Column, k: int, segments: int) -> Column:
    width = BITS // segments
    return F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit((1 << width) - 1))


def _stored(nodes: DataFrame, segments: int) -> DataFrame:
    """One row per fingerprint and segment."""
    places = F.array(*[F.struct(F.lit(k).alias("k"), _segment(F.col("fp"), k, segments).alias("part"))
                       for k in range(segments)])
    return nodes.select("fp", F.inline(places))


def _looked_up(stored: DataFrame, segments: int) -> DataFrame:
    """The segment itself and each variant with one set bit cleared."""
    bits = F.array(*[F.lit(1 << b).cast("long") for b in range(BITS // segments)])
    cleared = F.transform(F.filter(bits, lambda b: F.col("part").bitwiseAND(b) != 0),
                          lambda b: F.col("part").bitwiseXOR(b))
    return stored.select("k", F.col("fp").alias("other"), F.col("part").alias("own"),
                         F.explode(F.concat(F.array("part"), cleared)).alias("variant"))


def links(nodes: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Pairs (fp, other) whose links connect exactly the distinct fingerprints within the distance."""
    segments = distance // 2 + 1
    stored = _stored(nodes, segments)
    crowded = kept(stored.groupBy("k", "part").count().filter(F.col("count") > crowd).drop("count"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    lookups = _looked_up(stored, segments)
    has_crowds = not crowded.isEmpty()
    if has_crowds:
        full = small(crowded.select(F.col("k").alias("_k"), F.col("part").alias("_part")))
        here = (F.col("k") == F.col("_k")) & (F.col("part") == F.col("_part"))
        paired = stored.join(full, here, "left_anti")
    else:
        paired = stored
    pairs = lookups.withColumnRenamed("k", "j").join(
        paired, (F.col("j") == F.col("k")) & (F.col("variant") == F.col("part"))).filter(
        (apart <= distance) & ((F.col("own") != F.col("part")) | (F.col("other") < F.col("fp")))).select("fp", "other")
    if not has_crowds:
        return pairs
    members = lookups.join(full, (F.col("k") == F.col("_k")) & (F.col("variant") == F.col("_part")), "left_semi").select(
        F.col("other").alias("fp")).distinct()
    masks = F.array(*[F.lit(_signed(sum(1 << b for b in bits))).cast("long") for bits in combinations(range(BITS), distance)])
    variants = members.select("fp", F.explode(masks).alias("mask")).withColumn(
        "variant", F.col("fp").bitwiseAND(F.bitwise_not("mask")))
    heads = variants.groupBy("mask", "variant").agg(F.min("fp").alias("other"))
    stars = variants.join(heads, ["mask", "variant"]).filter("fp <> other").select("fp", "other").distinct()
    return pairs.union(stars)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    rows = kept(fingerprints(docs, size))
    nodes = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = kept(links(nodes.select("fp"), distance))
    named = found.join(nodes, "fp").select("other", F.col("node").alias("u")).join(
        nodes.select(F.col("fp").alias("other"), F.col("node").alias("v")), "other").filter(
        F.col("u").isNotNull() & F.col("v").isNotNull())
    roots = components(named.select("u", "v"))
    classes = nodes.join(roots, nodes.node == roots.node, "left").select(
        F.col("fp").alias("_fp"), F.coalesce("root", nodes.node).alias("component_id"))
    return rows.join(classes, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
