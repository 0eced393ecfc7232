"""Exact nearest confirmed cases by cosine similarity, as a blocked product.

Queries and cases are hashed into bounded chunks and blocks. Each task gets
one chunk and one block, multiplies the two matrices and emits only its best
candidates; a ranked merge then keeps the true best per query. No pair is
materialised and no side has to fit in one task, so both sides may grow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.session import cut_lineage
from riskloom.settings import Retrieval

BLOCK_ROWS = 20_000
CHUNK_ROWS = 5_000
# Parts of a side that are cut that small, for the tasks' sake; more rows go to larger parts of at most
# so many numbers, since each part is sent to all parts of the other side.
SMALL_PARTS = 16
PART_VALUES = 4_000_000
# Similarities a task holds at once.
TILE = 1_000_000
# Cases of a block whose best give the others a floor.
HEAD = 2_000
# Similarities are compared at this precision so equal vectors tie exactly.
TIE_DIGITS = 9
NORM_EPSILON = 1e-10


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + NORM_EPSILON)


def _best_of_block(fetch: int):
    """Task body: the ``fetch`` best cases of this block for each query of this chunk."""

    def run(queries: pd.DataFrame, cases: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(cases):
            cases = cases.sort_values("caseId", ignore_index=True)
            stored, members = _unit_rows(cases["vector"]), _members(cases)
            step = max(1, TILE // len(cases))
            for start in range(0, len(queries), step):
                part = queries.iloc[start:start + step]
                scores = _unit_rows(part["vector"]) @ stored.T
                best = _top(np.arange(len(part)), scores, np.arange(len(cases)), fetch)
                found.append(_named(best, part["queryKey"].to_numpy(), members, fetch))
        if not found:
            return pd.DataFrame({"queryKey": [], "caseId": [], "score": []})
        return pd.concat(found, ignore_index=True)

    return run


def _members(cases: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids that share each vector, one after the other: ids, their order, first place and number by vector."""
    if "ids" not in cases.columns:
        return cases["caseId"].to_numpy(), np.arange(len(cases)), np.arange(len(cases)), np.ones(len(cases), int)
    ids, sizes = np.concatenate(cases["ids"].to_numpy()), cases["ids"].map(len).to_numpy()
    return ids, pd.factorize(ids, sort=True)[0], np.cumsum(sizes) - sizes, sizes


def _named(best: pd.DataFrame, keys: np.ndarray, members: tuple, fetch: int) -> pd.DataFrame:
    """The ``fetch`` best cases of every row, out of its best vectors."""
    ids, place, first, sizes = members
    rows, at, score = (best[c].to_numpy() for c in ("queryKey", "caseId", "score"))
    count = sizes[at]
    held = np.repeat(first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
    rows, score = np.repeat(rows, count), np.repeat(score, count)
    if len(held) > len(best):
        order = np.lexsort((place[held], -np.round(score, TIE_DIGITS), rows))
        order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < fetch]
        rows, held, score = rows[order], held[order], score[order]
    return pd.DataFrame({"queryKey": keys[rows], "caseId": ids[held], "score": score})


def _top(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, fetch: int) -> pd.DataFrame:
    """The ``fetch`` best of every row of scores, ties to the smaller id; ``ids`` are sorted."""
    if scores.shape[1] > fetch:
        # No case below the fetch-th best of some of them is among the best; not a number counts as the best, so then all are looked at.
        head = scores if np.isnan(scores).any() else scores[:, :max(fetch, HEAD)]
        place = head.shape[1] - fetch
        floor = np.partition(head, place, axis=1)[:, place:place + 1]
        rows, at = np.nonzero(scores >= floor - 2 * 10.0 ** -TIE_DIGITS)
    else:
        rows, at = (found.ravel() for found in np.indices(scores.shape))
    compared = np.round(scores[rows, at], TIE_DIGITS)
    order = np.lexsort((at, -compared, rows))
    rows, at = rows[order], at[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < fetch
    rows, at = rows[best], at[best]
    return pd.DataFrame({"queryKey": keys[rows], "caseId": ids[at], "score": scores[rows, at]})


def _nearest() -> list:
    return [F.desc(F.round("score", TIE_DIGITS)), F.col("caseId")]


def _parts(df: DataFrame, rows: int) -> Column:
    """Into how many parts a frame with a ``vector`` is cut, as a scalar subquery: composing a plan runs no job.

    Parts have about ``rows`` rows; beyond ``SMALL_PARTS`` of them, as many as make ``PART_VALUES`` numbers, if that is more.
    """
    small = F.ceil(F.count(F.lit(1)) / rows)
    large = F.ceil(F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0)) / PART_VALUES)
    parts = F.greatest(F.lit(1), F.least(small, F.greatest(F.lit(SMALL_PARTS), large)))
    return df.agg(parts.cast("int").alias("parts")).scalar()


def top_candidates(queries: DataFrame, cases: DataFrame, fetch: int,
                   block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(queryKey, caseId, score): the ``fetch`` best cases per query.

    ``queries`` has queryKey and vector, ``cases`` has caseId and vector.
    Cases of one vector are compared once: of them only the ``fetch`` smallest
    ids can be among the best, and a vector that is not among the ``fetch`` best
    (ties to its smallest id) has no case that is.
    """
    alike = Window.partitionBy("vector").orderBy("caseId")
    cases = (
        cases.select("caseId", "vector", F.row_number().over(alike).alias("_place")).where(F.col("_place") <= fetch)
        .groupBy("vector").agg(F.min("caseId").alias("caseId"), F.sort_array(F.collect_list(F.struct("caseId"))).alias("ids"))
        .select("caseId", "vector", F.transform("ids", lambda i: i["caseId"]).alias("ids"))
    )
    blocks, chunks = _parts(cases, block_rows), _parts(queries, chunk_rows)
    left = queries.select(
        "queryKey", "vector",
        F.pmod(F.xxhash64("queryKey"), chunks).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
    )
    right = cases.select(
        "caseId", "vector", "ids",
        F.pmod(F.xxhash64("caseId"), blocks).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"),
    )
    key_type = queries.schema["queryKey"].dataType.simpleString()
    case_type = cases.schema["caseId"].dataType.simpleString()
    local = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(
        _best_of_block(fetch), f"queryKey {key_type}, caseId {case_type}, score double"
    )
    best = Window.partitionBy("queryKey").orderBy(*_nearest())
    return local.withColumn("candidateRank", F.row_number().over(best)).where(F.col("candidateRank") <= fetch)


def without_self(candidates: DataFrame, query: str, fetch: int) -> DataFrame:
    """The ``fetch`` best candidates of each query other than the query itself; needs one more than that."""
    best = Window.partitionBy(query).orderBy(*_nearest())
    return (
        candidates.where(F.col(query).cast("string") != F.col("caseId").cast("string"))
        .withColumn("candidateRank", F.row_number().over(best)).where(F.col("candidateRank") <= fetch)
    )


def own_customer_first(candidates: DataFrame, keep: int, threshold: float) -> DataFrame:
    """Same customer first, each side by similarity; cut to ``keep``; then the threshold.

    A missing query customer leaves plain similarity order.
    """
    foreign = ~F.coalesce(F.col("caseCustomer") == F.col("queryCustomer"), F.lit(False))
    order = Window.partitionBy("queryId").orderBy(foreign, *_nearest())
    return (
        candidates.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= keep)
        .withColumn("similarity", F.round("score", 4))
        .where(F.col("similarity") >= threshold)
        .select("queryId", "caseId", "similarity", "rank")
    )


def similar_cases(queries: DataFrame, cases: DataFrame, retrieval: Retrieval = Retrieval(),
                  block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(queryId, caseId, similarity, rank) of the kept cases.

    ``queries`` has queryId, customerId and vector; ``cases`` has caseId,
    customerId and vector. Equal query vectors (one attack produces many) are
    compared once and joined back, so copies cost nothing extra.
    """
    distinct = queries.groupBy("vector").agg(F.min("queryId").alias("queryKey"))
    return _for_each_customer(queries, distinct, "vector", cases, retrieval, block_rows, chunk_rows)


def similar_texts(queries: DataFrame, cases: DataFrame, embed, retrieval: Retrieval = Retrieval(),
                  block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """As :func:`similar_cases` for queries that carry ``text`` instead of a vector.

    ``embed`` turns a frame with ``text`` into one with ``vector``; it runs
    once per distinct text.
    """
    texts = queries.groupBy("text").agg(F.min("queryId").alias("queryKey"))
    return _for_each_customer(queries, cut_lineage(embed(texts)), "text", cases, retrieval, block_rows, chunk_rows)


def _for_each_customer(queries, distinct, key, cases, retrieval, block_rows, chunk_rows) -> DataFrame:
    """Candidates per distinct query, joined back and ordered for each customer."""
    found = top_candidates(distinct.select("queryKey", "vector"), cases.select("caseId", "vector"),
                           retrieval.fetch + 1, block_rows, chunk_rows)
    owners = cases.select("caseId", F.col("customerId").alias("caseCustomer"))
    gathered = (
        found.join(owners, "caseId")
        .groupBy("queryKey")
        .agg(F.sort_array(F.collect_list(F.struct((-F.round("score", TIE_DIGITS)).alias("order"), "caseId", "score", "caseCustomer"))).alias("hits"))
    )
    by_key = distinct.join(gathered, "queryKey").select(F.col(key).alias("_key"), "hits")
    asked = queries.select("queryId", F.col("customerId").alias("queryCustomer"), key).where(F.col("queryId").isNotNull())
    asked = asked.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("queryId")))
    # A query of one row is cut before its cases become rows; rows that share a query share its places.
    hits = F.when(F.col("_rows") == 1, _kept_hits(retrieval)).otherwise(F.col("hits"))
    candidates = (
        asked.join(by_key, F.col(key) == F.col("_key"))
        .select("queryId", "queryCustomer", hits.alias("hits")).select("queryId", "queryCustomer", F.inline("hits")).drop("order")
    )
    return own_customer_first(without_self(candidates, "queryId", retrieval.fetch), retrieval.keep, retrieval.threshold)


def _kept_hits(retrieval: Retrieval) -> Column:
    """What :func:`without_self` and :func:`own_customer_first` keep of a sorted list of hits."""
    others = F.filter("hits", lambda h: h["caseId"].cast("string") != F.col("queryId").cast("string"))

    def placed(h: Column) -> Column:
        foreign = ~F.coalesce(h["caseCustomer"] == F.col("queryCustomer"), F.lit(False))
        return F.struct(foreign.alias("foreign"), h.alias("hit"))

    ordered = F.sort_array(F.transform(F.slice(others, 1, retrieval.fetch), placed))
    return F.transform(F.slice(ordered, 1, retrieval.keep), lambda p: p["hit"])


def lsh_candidates(queries: DataFrame, cases: DataFrame, distance: float, seed: int = 7) -> DataFrame:
    """Approximate pairs within a Euclidean distance (optional, for exploration).

    For unit vectors, cosine >= c means distance <= sqrt(2 - 2c).
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    left = queries.select("queryId", array_to_vector("vector").alias("features"))
    right = cases.select("caseId", array_to_vector("vector").alias("features"))
    hasher = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=2 * distance, numHashTables=4, seed=seed)
    pairs = hasher.fit(right).approxSimilarityJoin(left, right, distance, "distance")
    return pairs.select(
        F.col("datasetA.queryId").alias("queryId"), F.col("datasetB.caseId").alias("caseId"), "distance")
