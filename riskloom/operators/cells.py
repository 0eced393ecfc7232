"""Exact nearest cases through an index of cells, with a proof that nothing was missed.

Unit vectors are dealt to the nearest of a few centroids fitted on a bounded
sample; a cell knows the largest distance of its cases from its centroid. A
query's similarity to a case of a cell is at most the cosine of (its angle to
the centroid minus the cell's largest angle). Cells are visited in turns by
that bound: once a query's ``fetch``-th best similarity found is above the
bounds of all cells it has not visited, its answer is proved complete and it
leaves. A visit returns only cases that reach the query's ``fetch``-th best of
the turns before. In the worst case a query visits every cell, or, once that sends
less, the blocks of the plain product, and the answer is still exact. Large cells are cut into parts by a hash, so no task holds a cell that
grows with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.similarity import BLOCK_ROWS, CHUNK_ROWS, SMALL_PARTS, _best_of_block, _nearest, _parts, top_candidates
from riskloom.session import cut_lineage, discard, written

#: Cases that centroids are fitted on at most (which cells there are, not what is found), and rounds of fitting.
SAMPLE = 20_000
ROUNDS = 8
#: Rows of a cell's part in one task.
PART_ROWS = 20_000
#: Queries whose cells are ordered at once.
ORDERED = 1_000
#: Slack of the bound against rounding.
SLACK = 1e-9


def _unit(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + 1e-10)


def fit_centroids(cases: DataFrame, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means on the cases whose ids hash lowest, at most ``SAMPLE`` of them."""
    rows = cases.orderBy(F.xxhash64("caseId"), "caseId").limit(SAMPLE).select("vector").collect()
    if not rows:
        return np.zeros((0, 1))
    sample = _unit([r["vector"] for r in rows])
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centroids)
    return centroids


def _dealt(cases: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Cases with their cell and their angle to its centroid."""
    shared = cases.sparkSession.sparkContext.broadcast(centroids)

    def work(frames):
        for frame in frames:
            score = np.clip(_unit(frame["vector"]) @ shared.value.T, -1, 1)
            cell = score.argmax(axis=1)
            yield frame.assign(cell=cell.astype(np.int32), angle=np.arccos(score[np.arange(len(cell)), cell]))

    kind = cases.schema["caseId"].dataType.simpleString()
    vector = cases.schema["vector"].dataType.simpleString()
    return cases.select("caseId", "vector").mapInPandas(work, f"caseId {kind}, vector {vector}, cell int, angle double")


def _next_cells(queries: DataFrame, centroids: np.ndarray, cells: pd.DataFrame, seen: int, upto: int) -> DataFrame:
    """The rows with ``visited``, their cells from ``seen`` to ``upto`` by falling bound, and ``next``, the bound of the one after.

    Worked out again in each turn: kept, the order of all cells would be a table of queries times cells.
    """
    shared = queries.sparkSession.sparkContext.broadcast((centroids[cells["cell"]], cells["cell"].to_numpy(), cells["angle"].to_numpy()))

    def work(frames):
        centres, numbers, angles = shared.value
        for frame in (f.iloc[k:k + ORDERED] for f in frames for k in range(0, len(f), ORDERED)):
            away = np.arccos(np.clip(_unit(frame["vector"]) @ centres.T, -1, 1))
            bound = np.cos(np.maximum(away - angles, 0)) + SLACK
            order = np.argsort(-bound, axis=1, kind="stable")
            after = bound[np.arange(len(frame)), order[:, upto]] if upto < len(numbers) else np.nan
            yield frame.assign(visited=list(numbers[order[:, seen:upto]].astype(np.int32)), next=after)

    kind, vector = (queries.schema[c].dataType.simpleString() for c in ("queryKey", "vector"))
    return queries.select("queryKey", "vector", "floor").mapInPandas(
        work, f"queryKey {kind}, vector {vector}, floor double, visited array<int>, next double")


def _best_above(fetch: int):
    """As the blocked product, without cases below ``floor``, what the query's answer has reached already."""
    best = _best_of_block(fetch)

    def run(queries: pd.DataFrame, cases: pd.DataFrame) -> pd.DataFrame:
        found = best(queries, cases)
        floors = queries[queries["floor"].notna() & queries["queryKey"].notna()].drop_duplicates("queryKey")
        if not len(found) or not len(floors):
            return found
        floor = found["queryKey"].map(floors.set_index("queryKey")["floor"])
        return found[~(found["score"] < floor - 2 * SLACK)]

    return run


def certified_candidates(queries: DataFrame, cases: DataFrame, fetch: int, cells: int | None = None, visits: int = 4,
                         part_rows: int = PART_ROWS) -> tuple[DataFrame, int]:
    """(queryKey, caseId, score), the ``fetch`` best cases per query, and the number of products that took.

    The first turn visits ``visits`` cells, each further turn twice as many,
    for the queries that are not proved yet. Queries that are still open when a
    turn would send more vectors than the blocked product meet all cases there.
    """
    spark, total = queries.sparkSession, cases.count()
    key_type, case_type = queries.schema["queryKey"].dataType.simpleString(), cases.schema["caseId"].dataType.simpleString()
    kind = f"queryKey {key_type}, caseId {case_type}, score double"
    if not total:
        return spark.createDataFrame([], kind), 0
    centroids = fit_centroids(cases, cells or max(1, int(total**0.5 / 2)))
    dealt = cut_lineage(_dealt(cases, centroids))
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).orderBy("cell").toPandas()  # one row a cell
    known = spark.createDataFrame([(int(c), int(n), max(1, -(-int(n) // part_rows))) for c, n in zip(sizes["cell"], sizes["n"])],
                                  "cell int, n long, parts int")
    order = Window.partitionBy("queryKey").orderBy(*_nearest())
    open_ = queries.select("queryKey", "vector", F.lit(None).cast("double").alias("floor"))
    found, held, products, seen = None, [], 0, 0
    while True:
        if seen and visits > max(SMALL_PARTS, _sent_in_blocks(open_, dealt, total)):
            whole = top_candidates(open_.select("queryKey", "vector"), dealt.select("caseId", "vector"), fetch)
            closed = found.join(open_.select(F.col("queryKey").alias("_key")).distinct(), F.col("queryKey").eqNullSafe(F.col("_key")), "left_anti")
            both, products, upto = closed.union(whole.select(*found.columns)), products + open_.count() * total, len(sizes)
        else:
            upto = min(len(sizes), seen + visits)
            ordered = _next_cells(open_, centroids, sizes, seen, upto)
            visit = ordered.select("queryKey", "vector", "floor", F.explode("visited").alias("cell"))
            # Queries of a popular cell are dealt to several tasks, and so are the cases of a large one.
            asked = visit.groupBy("cell").agg(F.count("*").alias("asked")).join(F.broadcast(known), "cell")
            asked = cut_lineage(asked.withColumn("chunks", F.ceil(F.col("asked") / part_rows).cast("int")))
            products += asked.agg(F.sum(F.col("asked") * F.col("n"))).first()[0] or 0
            deal = F.broadcast(asked.select("cell", "parts", "chunks"))  # one row a cell
            left = visit.join(deal, "cell").select(
                "queryKey", "vector", "floor", "cell", F.pmod(F.xxhash64("queryKey"), F.col("chunks")).cast("int").alias("chunk"),
                F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            right = dealt.join(deal, "cell").select(
                "caseId", "vector", "cell", F.pmod(F.xxhash64("caseId"), F.col("parts")).cast("int").alias("part"),
                F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
            by = ["cell", "chunk", "part"]
            local = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_best_above(fetch), kind)
            both = local if found is None else found.union(local)
        found, path = written(both.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= fetch).drop("_rank"))
        old, held = held, [path]
        if upto < len(sizes):
            worst = found.groupBy(F.col("queryKey").alias("_key")).agg(F.count("*").alias("_n"), F.min("score").alias("_worst"))
            proved = F.coalesce((F.col("_n") >= fetch) & (F.col("_next") < F.col("_worst") - SLACK), F.lit(False))
            # Rows that share a key share its answer, so they leave together.
            told = ordered.join(worst, F.col("queryKey") == F.col("_key"), "left").withColumn("_next", F.max("next").over(Window.partitionBy("queryKey")))
            open_, path = written(told.where(~proved).select("queryKey", "vector", F.when(F.col("_n") >= fetch, F.col("_worst")).alias("floor")))
            held.append(path)
        for path in old:
            discard(spark, path)
        if upto == len(sizes) or open_.isEmpty():
            return found, products
        seen, visits = upto, 2 * visits


def _sent_in_blocks(open_: DataFrame, dealt: DataFrame, total: int) -> float:
    """Vectors that the blocked product of the open queries with all cases sends, for each query."""
    row = open_.agg(F.count("*").alias("n")).select("n", _parts(dealt, BLOCK_ROWS).alias("blocks"), _parts(open_, CHUNK_ROWS).alias("chunks")).first()
    return row["blocks"] + row["chunks"] * total / max(1, row["n"])
