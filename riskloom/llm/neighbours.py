"""Nearest neighbours by cross-polytope hashing (Andoni et al. 2015).

Unit vectors are turned by pseudo-random rotations (three rounds of random
signs and a fast Hadamard transform) and stand, in each of ``TABLES`` tables,
under the nearest signed axis. A query visits the ``PROBES`` axes nearest to
it in every table; what it meets is reranked by the exact cosine. A query that
met fewer than ``k`` candidates visits all axes of the first table, which hold
every vector, so only a query with fewer candidates at all gets fewer rows.
The plan is the same at every size.

Each bucket is dealt in blocks of about ``BLOCK`` rows, and its queries in
blocks too, so a bucket with a third of all rows is many tasks' work; a block
keeps only what can still be among a query's nearest, ties included. Vectors
are written once, with the axes they stand under.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; so do vectors of another length than most have.
Rows with equal ids are separate candidates; a row with a query's id is the
query's own. Query rows with equal ids get one answer, in which a candidate
counts with the largest of its scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import kept, ship

TABLES = 4
PROBES = 28
SEED = 20
BLOCK = 20_000
QUERY_BLOCK = 2_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, without scaling."""
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        half *= 2
    return x


def padded(size: int) -> int:
    """The power of two that vectors of this size are padded to."""
    return 1 << max(0, size - 1).bit_length()


def rotated(unit: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """The pseudo-rotation of one table, up to scale; rows are padded to a power of two."""
    width = padded(unit.shape[1])
    x = np.zeros((len(unit), width))
    x[:, :unit.shape[1]] = unit
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], size=(3, width))
    for flip in signs:
        x = hadamard(x * flip) / np.sqrt(width)
    return x


def axes(unit: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: axis i, or i + width for its negative."""
    x = rotated(unit, table)
    both = np.concatenate([x, -x], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    raw = np.stack([np.asarray(v, np.float64) for v in vectors])
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _hashed(tables: int, probes: int):
    """Append ``spots``: for each table the nearest axes, numbered on from table to table."""
    def work(frames):
        for frame in frames:
            for at in range(0, len(frame), 2000):
                part = frame.iloc[at:at + 2000]
                _, unit = _unit(part["v"])
                found = [axes(unit, t, probes) + t * 2 * padded(unit.shape[1]) for t in range(tables)]
                yield part.assign(spots=list(np.concatenate(found, axis=1)))

    return work


def _rerank(k: int):
    def work(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "row": [], "score": []})
        q_raw, q = _unit(queries["v"])
        c_raw, c = _unit(rows["v"])
        q_id, c_id, c_row = queries["id"].to_numpy(), rows["id"].to_numpy(), rows["row"].to_numpy()
        out = []
        for at in range(0, len(q), 200):
            near = q[at:at + 200] @ c.T
            near[q_id[at:at + 200, None] == c_id[None, :]] = -np.inf
            if near.shape[1] > k:
                floor = -np.partition(-near, k - 1, axis=1)[:, k - 1:k] - 1e-9  # ties are told apart exactly below
            else:
                floor = np.full((len(near), 1), -2.0)
            qs, cs = np.nonzero((near >= floor) & np.isfinite(near))
            a, b = q_raw[at + qs], c_raw[cs]
            score = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
            found = pd.DataFrame({"query_id": q_id[at + qs], "vec_id": c_id[cs], "row": c_row[cs], "score": score, "asked": qs})
            found = found.sort_values(["asked", "score", "vec_id", "row"], ascending=[True, False, True, True])
            out.append(found.groupby("asked", sort=False).head(k).drop(columns="asked"))
        return pd.concat(out)

    return work


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """id and v of the vectors that take part, and their size."""
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.simpleString() != "array<float>":  # floats are doubles already, in half the space
        v = v.cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    read = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    sizes = read.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = sizes["n"] if sizes else 0
    return read.filter(F.size("v") == size), size


def _search(index: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    """query_id, vec_id, row and score of the nearest rows that each query meets at its spots; written."""
    sizes = index.groupBy("spot").count().select("spot", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    wanted = asked.groupBy("spot").count().select("spot", F.ceil(F.col("count") / QUERY_BLOCK).cast("int").alias("q_blocks"))
    # One row per signed axis and table: at most 2 * tables * padded dimension, whatever the input.
    plan = F.broadcast(kept(sizes.join(wanted, "spot")))
    dealt = index.join(plan, "spot").select(
        "spot", F.pmod(F.xxhash64("id", "row"), "blocks").cast("int").alias("b"),
        F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"), "id", "row", "v")
    sent = asked.join(plan, "spot").select(
        "spot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"),
        F.pmod(F.xxhash64("id", "row", F.lit(1)), "q_blocks").cast("int").alias("qb"), "id", "v")
    keys = ["spot", "b", "qb"]
    found = sent.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(_rerank(k), "query_id long, vec_id long, row long, score double")
    once = found.groupBy("query_id", "row").agg(F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row")
    return kept(once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES, probes: int = PROBES,
            block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's nearest rows found.

    ``is_query`` is a condition on the column ``id``; the query set is searched
    against all rows, bucket by bucket.
    """
    ship(vectors.sparkSession)
    read, size = usable(vectors, id_col, vector_col)
    layout = f"id long, row long, v {read.schema['v'].dataType.simpleString()}, spots array<long>"
    hashed = kept(read.select("id", F.monotonically_increasing_id().alias("row"), "v").mapInPandas(_hashed(tables, 1), layout))
    asked = kept(hashed.filter(is_query).drop("spots").mapInPandas(_hashed(tables, probes), layout))
    index = hashed.select("id", "row", "v", F.explode("spots").alias("spot"))
    found = _search(index, asked.select("id", "row", "v", F.explode("spots").alias("spot")), k, block)
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("full"))
    short = kept(asked.drop("spots").join(full, F.col("id") == F.col("full"), "left_anti"))
    answer = ["query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"]
    if short.isEmpty():
        return found.select(*answer)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * padded(size) - 1).cast("long")))
    whole = _search(index.filter(F.col("spot") < 2 * padded(size)), short.withColumn("spot", every), k, block)
    return found.join(full, F.col("query_id") == F.col("full"), "left_semi").select(*answer).union(whole.select(*answer))
