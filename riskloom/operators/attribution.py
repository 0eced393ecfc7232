"""Shapley values of boosted trees, path by path.

The value of a set S of known features is the trees' margin when splits on
other features are averaged by the training weight of their branches. A leaf
contributes its value times, for each feature on its path, one or zero (known:
does the row take the path?) or the share of weight that takes it (unknown). So
every path is a game of its few features alone, and its Shapley values depend
on the row only through which of its features take the path: one table of
values a path and pattern, worked out once from the stored nodes, one lookup a
row and path afterwards. Contributions add up to margin minus base. Of the rows
of a batch only those that a tree tells apart, by its own few thresholds, are
looked up in its tables.

Nodes are read from the stored model, at most trees x 2 ^ (depth + 1) of them,
whatever the data.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.session import shared_folder

#: Different features on one path; a table has two to this power rows.
MOST = 12


@dataclass(frozen=True)
class Path:
    """One leaf: its value, for each feature on the way the interval (low, high] and the share of weight that takes it, and its tree."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]
    tree: int = 0


def stored_nodes(model: PipelineModel) -> DataFrame:
    """tree, weight, node, value, cover, left, right, feature and threshold of the model's booster."""
    booster, session = model.stages[-1], SparkSession.getActiveSession()
    folder = f"{shared_folder(session)}/riskloom-nodes-{uuid.uuid4().hex}"
    booster.write().save(folder)
    nodes = session.read.parquet(f"{folder}/data")
    weights = session.read.parquet(f"{folder}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
    return nodes.select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.impurityStats")[0].alias("cover"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", 0).alias("threshold")).join(F.broadcast(weights), "tree")


def paths(model: PipelineModel) -> list[Path]:
    """All leaves of the model; splits on one feature along a path become one interval."""
    nodes = {(r["tree"], r["node"]): r for r in stored_nodes(model).collect()}
    found = []

    def walk(tree: int, node: int, way: dict[int, tuple[float, float, float]]) -> None:
        here = nodes[tree, node]
        if here["left"] < 0:
            found.append(Path(here["weight"] * here["value"], tuple(way), *(tuple(x[k] for x in way.values()) for k in range(3)), tree))
            return
        low, high, share = way.get(here["feature"], (-math.inf, math.inf, 1.0))
        left, right = nodes[tree, here["left"]], nodes[tree, here["right"]]
        whole = left["cover"] + right["cover"]
        for child, bounds in ((left, (low, min(high, here["threshold"]))), (right, (max(low, here["threshold"]), high))):
            part = child["cover"] / whole if whole else 0.5
            walk(tree, child["node"], {**way, here["feature"]: (*bounds, share * part)})

    for tree in sorted({t for t, _ in nodes}):
        walk(tree, 0, {})
    return found


def base(all_paths: list[Path]) -> float:
    """The margin when no feature is known."""
    return math.fsum(p.value * math.prod(p.share) for p in all_paths)


def pattern_values(path: Path) -> np.ndarray:
    """Shapley values by pattern (bit k: feature k takes the path) and feature."""
    m = len(path.features)
    if m > MOST:
        raise ValueError(f"a path holds {m} features, more than {MOST}")
    takes = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    share = np.array(path.share)
    values = np.zeros((1 << m, m))
    weights = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
    for feature in range(m):
        # Column k: sum over sets of k other features of what known and unknown ones contribute.
        sums = np.zeros((1 << m, m))
        sums[:, 0] = 1.0
        for other in range(m):
            if other != feature:
                sums[:, 1:] = sums[:, 1:] * share[other] + sums[:, :-1] * takes[:, other:other + 1]
                sums[:, 0] *= share[other]
        values[:, feature] = path.value * (takes[:, feature] - share[feature]) * (sums @ weights)
    return values


class Explainer:
    """Tables of all paths by tree, and the thresholds that a tree splits each of its features at."""

    def __init__(self, all_paths: list[Path]):
        self.base = base(all_paths)
        self.tables, cuts = {}, {}
        for path in all_paths:
            if path.features:
                self.tables.setdefault(path.tree, []).append((path.features, path.low, path.high, pattern_values(path)))
                for feature, *ends in zip(path.features, path.low, path.high):
                    cuts.setdefault(path.tree, {}).setdefault(feature, set()).update(e for e in ends if math.isfinite(e))
        self.cuts = {tree: {f: np.array(sorted(t)) for f, t in of.items()} for tree, of in cuts.items()}
        every = {f: [of[f] for of in self.cuts.values() if f in of] for f in {f for of in self.cuts.values() for f in of}}
        self.every = {f: np.unique(np.concatenate(t)) for f, t in every.items()}

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Per row and feature, for rows of model inputs."""
        out = np.zeros(x.shape)
        # How many thresholds lie below an input; not a number lies above all, and goes right as in the model.
        below = {f: np.searchsorted(cuts, x[:, f]) for f, cuts in self.every.items()}
        for tree, tables in self.tables.items():
            first, kind = self._kinds(tree, below, len(x))
            out += self._of_tree(tables, x[first])[kind]
        return out

    def _kinds(self, tree: int, below: dict[int, np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The first row of each kind that all splits of a tree send the same way, and each row's kind."""
        kind, most = np.zeros(rows, dtype=np.int64), 1
        for feature, cuts in self.cuts[tree].items():
            if most * (len(cuts) + 1) >= 1 << 62:
                kind = np.unique(kind, return_inverse=True)[1]
                most = rows
            places = np.searchsorted(cuts, np.append(self.every[feature], np.inf))
            kind = kind * (len(cuts) + 1) + places[below[feature]]
            most *= len(cuts) + 1
        return np.unique(kind, return_index=True, return_inverse=True)[1:]

    @staticmethod
    def _of_tree(tables: list, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for features, low, high, values in tables:
            columns = list(features)
            inputs = x[:, columns]
            # Not a number goes right at every split, as in the model.
            takes = ~(inputs <= np.array(low)) & ((inputs <= np.array(high)) | (np.array(high) == np.inf))
            out[:, columns] += values[takes @ (1 << np.arange(len(columns)))]
        return out


_explainers: dict[str, Explainer] = {}


def tree_attributions(model: PipelineModel, df: DataFrame, features: list[str] = S.FEATURES) -> DataFrame:
    """Append ``contributions`` to the margin by feature, ``base`` and ``margin`` (the log-odds are twice the margin)."""
    all_paths = paths(model)
    key = uuid.uuid4().hex
    shared = df.sparkSession.sparkContext.broadcast(all_paths)

    @F.pandas_udf("array<double>")
    def explain(inputs: pd.Series) -> pd.Series:
        if key not in _explainers:  # one model's tables a worker
            _explainers.clear()
            _explainers[key] = Explainer(shared.value)
        return pd.Series(list(_explainers[key].contributions(np.stack(inputs.to_numpy())))) if len(inputs) else pd.Series([], dtype=object)

    added = ["rawFeatures", "features", "rawPrediction", "probability", "prediction"]
    known = model.transform(df.drop(*[c for c in added if c in df.columns]))
    told = known.withColumns({"_parts": explain(vector_to_array("features")), "margin": vector_to_array("rawPrediction")[1], "base": F.lit(base(all_paths))})
    parts = F.array(*[F.struct(F.lit(name).alias("feature"), F.col("_parts")[k].alias("value")) for k, name in enumerate(features)])
    return told.withColumn("contributions", parts).drop("_parts", *added)
