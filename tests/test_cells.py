"""The certified cell index against brute force."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import cells, similarity


def frames(spark, queries, cases):
    left = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(queries)], "queryKey long, vector array<double>")
    right = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(cases)], "caseId long, vector array<double>")
    return left, right


def brute(queries, cases, fetch):
    unit = [m / (np.linalg.norm(m, axis=1, keepdims=True) + similarity.NORM_EPSILON) for m in (queries, cases)]
    scores = np.round(unit[0] @ unit[1].T, similarity.TIE_DIGITS)
    return {q: np.lexsort((np.arange(len(cases)), -s))[:fetch].tolist() for q, s in enumerate(scores)}


def answers(found):
    out = {}
    for r in found.orderBy("queryKey", F.desc(F.round("score", similarity.TIE_DIGITS)), "caseId").collect():
        out.setdefault(r.queryKey, []).append(r.caseId)
    return out


def test_groups_are_proved_early_and_hot_cells_are_cut(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    of = np.concatenate([np.zeros(900, int), rng.integers(0, 30, 1800)])  # a third in one group
    cases = centres[of] + rng.normal(size=(2700, 24)) * 0.03
    cases[100:140] = cases[100]  # ties
    queries = np.concatenate([centres[rng.integers(0, 30, 80)] + rng.normal(size=(80, 24)) * 0.03, cases[100:101]])
    found, products = cells.certified_candidates(*frames(spark, queries, cases), 20, part_rows=300)
    assert answers(found) == brute(queries, cases, 20)
    assert products < 0.4 * len(queries) * len(cases)


@pytest.mark.parametrize("n", [0, 3, 400])
def test_without_structure_every_cell_is_visited(spark, n):
    rng = np.random.default_rng(n)
    cases, queries = rng.normal(size=(n, 16)), rng.normal(size=(12, 16))
    queries[0] = 0  # no direction
    left, right = frames(spark, queries, cases)
    found, products = cells.certified_candidates(left, right, 20)
    assert answers(found) == ({} if n == 0 else brute(queries, cases, 20)) and products <= n * 12


def test_open_queries_meet_blocks_once_cells_would_send_more(spark, monkeypatch):
    rng = np.random.default_rng(9)
    cases, queries = rng.normal(size=(400, 16)), rng.normal(size=(420, 16))
    cases[10:40] = cases[10]  # ties
    left, right = frames(spark, queries, cases)
    left = left.union(spark.createDataFrame([(3, cases[10].tolist())], left.schema))  # a key of two vectors
    met, product, kept, write = [], cells.top_candidates, [], cells.written
    monkeypatch.setattr(cells, "top_candidates", lambda q, c, n: met.append(q.count()) or product(q, c, n))
    monkeypatch.setattr(cells, "written", lambda df: kept.append(write(df)) or kept[-1])
    found, _ = cells.certified_candidates(left, right, 20, cells=60)
    want = brute(queries, cases, 20)
    got = answers(found)
    assert met and met[0] <= 421 and {k: v for k, v in got.items() if k != 3} == {k: v for k, v in want.items() if k != 3}
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (queries[3:4], cases[10:11], cases)]
    score = np.round(np.concatenate([unit[0] @ unit[2].T, unit[1] @ unit[2].T]), similarity.TIE_DIGITS)
    assert got[3] == (np.lexsort((np.tile(np.arange(400), 2), -score.ravel()))[:20] % 400).tolist()
    # No table of queries times cells, and only the last answer stays written.
    for df, _ in kept:
        assert not [name for name, kind in df.dtypes if name != "vector" and kind.startswith("array")]
    files = [pathlib.Path(path).exists() for _, path in kept]
    assert files[-1] and not any(files[:-1])
