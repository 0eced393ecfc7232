"""Online model: drift-adaptive trees on random feature subsets, learning by micro-batch.

Ten members see each row a Poisson(``BAGGING``) number of times, drawn from a
hash of the row's key, and each looks at its own features only. What a batch
teaches is one sum: rows by (member, leaf, feature, bin, label), added up in
each task and then by one aggregate, so batches and partitions merge exactly.
From those sums the driver grows the trees: a leaf splits when the Hoeffding
bound says that its best split is the best. Each member's errors, made before
it learns, enter an adaptive window; when the window's newer part is worse than
its older part beyond chance, the window is cut there and the member starts
anew from this batch's sums.

The driver holds the model alone: members x leaves x features x bins, whatever
the data.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.feedback import ONLINE_FEATURES

MEMBERS = 10
#: Features a member looks at, bins of a feature's range 0 to 1, leaves of a tree at most.
SUBSPACE = 3
BINS = 32
LEAVES = 64
#: Mean number of times a member sees a row.
BAGGING = 6.0
#: Chance that a split is not the best one; difference of gains below which two splits tie; rows between attempts.
SPLIT_DELTA = 1e-7
TIE = 0.05
GRACE = 50
#: Chance that a window is cut without drift.
DRIFT_DELTA = 0.002
#: Buckets of one size that a window keeps before two become one.
SAME_SIZE = 5


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well spread for neighbouring inputs."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def poisson_cuts(mean: float = BAGGING) -> np.ndarray:
    """Cumulative probabilities up to the last one that a 53-bit draw can tell from 1."""
    cuts, k, term = [], 0, math.exp(-mean)
    while not cuts or cuts[-1] < 1 - 2.0**-53 and term > 0:
        cuts.append((cuts[-1] if cuts else 0.0) + term)
        k += 1
        term *= mean / k
    return np.array(cuts)


def copies(keys: np.ndarray, member: int, seed: int, mean: float = BAGGING) -> np.ndarray:
    """How often the member sees each row, from a hash of its key."""
    with np.errstate(over="ignore"):
        drawn = _mix(keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + member + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return np.searchsorted(poisson_cuts(mean), (drawn >> np.uint64(11)) / float(1 << 53), side="right")


@dataclass
class Tree:
    """Arrays by node; a leaf has feature -1 and keeps rows by (feature, bin, label) in ``sums``."""

    features: list[int]
    feature: list[int] = field(default_factory=lambda: [-1])
    edge: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    counts: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0]])
    sums: dict[str, list] = field(default_factory=dict)
    tried: dict[str, float] = field(default_factory=dict)

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of binned inputs."""
        at = np.zeros(len(bins), np.int64)
        feature, edge, left, right = map(np.array, (self.feature, self.edge, self.left, self.right))
        rows = np.arange(len(bins))
        while (inner := feature[at] >= 0).any():
            goes = bins[rows, np.maximum(feature[at], 0)] <= edge[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
        return at

    def probability(self) -> np.ndarray:
        """Share of label 1 by node, one row of each label added."""
        counts = np.array(self.counts)
        return (counts[:, 1] + 1) / (counts.sum(axis=1) + 2)

    def add(self, leaf: int, table: np.ndarray) -> None:
        """``table``: rows by own feature, bin and label."""
        old = np.array(self.sums.get(str(leaf), np.zeros_like(table)))
        self.sums[str(leaf)] = (old + table).tolist()
        self.counts[leaf] = (np.array(self.counts[leaf]) + table[0].sum(axis=0)).tolist()
        self._split(leaf)

    def _split(self, leaf: int) -> None:
        table = np.array(self.sums[str(leaf)])
        n = table[0].sum()
        if n - self.tried.get(str(leaf), 0) < GRACE or sum(f < 0 for f in self.feature) >= LEAVES:
            return
        self.tried[str(leaf)] = n
        gains = _gains(table)
        best = [(float(g.max()), k, int(g.argmax())) for k, g in enumerate(gains)]
        best.sort(reverse=True)
        bound = math.sqrt(math.log(1 / SPLIT_DELTA) / (2 * n))
        second = best[1][0] if len(best) > 1 else 0.0
        if best[0][0] <= 0 or best[0][0] - second <= bound and bound >= TIE:
            return
        _, own, edge = best[0]
        parts = [table[own, :edge + 1].sum(axis=0), table[own, edge + 1:].sum(axis=0)]
        for side, part in (("left", parts[0]), ("right", parts[1])):
            getattr(self, side)[leaf] = len(self.feature)
            self.feature.append(-1)
            self.edge.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.counts.append(part.tolist())
        self.feature[leaf], self.edge[leaf] = self.features[own], edge
        del self.sums[str(leaf)], self.tried[str(leaf)]


def _entropy(counts: np.ndarray) -> np.ndarray:
    whole = counts.sum(axis=-1, keepdims=True)
    share = counts / np.maximum(whole, 1e-300)
    return -(share * np.log2(np.maximum(share, 1e-300))).sum(axis=-1)


def _gains(table: np.ndarray) -> np.ndarray:
    """Information gained by splitting after each bin, by feature; no gain where a side is empty."""
    below = table.cumsum(axis=1)[:, :-1]
    whole = table.sum(axis=1, keepdims=True)
    above = whole - below
    n, a, b = whole.sum(axis=2), below.sum(axis=2), above.sum(axis=2)
    gain = _entropy(whole) - (a * _entropy(below) + b * _entropy(above)) / np.maximum(n, 1)
    return np.where((a > 0) & (b > 0), gain, 0.0)


@dataclass
class Window:
    """Errors in buckets of growing size, oldest first; cut where its two sides differ beyond chance."""

    buckets: list[list[float]] = field(default_factory=list)

    def add(self, rows: int, errors: float) -> bool:
        """Append a batch; True if the newer part proved worse, and the older was dropped."""
        if rows:
            self.buckets.append([rows, errors])
        worse = False
        while (cut := self._cut()) is not None:
            at, rose = cut
            self.buckets = self.buckets[at:]
            worse |= rose
        self._merge()
        return worse

    def _cut(self) -> tuple[int, bool] | None:
        table = np.array(self.buckets, float).reshape(-1, 2)
        n, errors = table.sum(axis=0)
        if len(table) < 2:
            return None
        mean = errors / n
        spread, log = mean * (1 - mean), math.log(2 * max(1.0, math.log(n)) / DRIFT_DELTA)
        for at in range(1, len(table)):
            (n0, e0), (n1, e1) = table[:at].sum(axis=0), table[at:].sum(axis=0)
            m = 1 / (1 / n0 + 1 / n1)
            if abs(e1 / n1 - e0 / n0) > math.sqrt(2 / m * spread * log) + 2 / (3 * m) * log:
                return at, e1 / n1 > e0 / n0
        return None

    def _merge(self) -> None:
        """At most ``SAME_SIZE`` buckets between one power of two of rows and the next."""
        size = lambda bucket: int(math.log2(bucket[0]))
        at = len(self.buckets) - 1
        while at >= 0:
            same = [k for k, b in enumerate(self.buckets) if size(b) == size(self.buckets[at])]
            if len(same) > SAME_SIZE:
                first, second = same[:2]
                merged = [a + b for a, b in zip(self.buckets[first], self.buckets[second])]
                self.buckets[first:second + 1] = [merged, *self.buckets[first + 1:second]]
                at = len(self.buckets) - 1
            else:
                at -= 1


def _subspaces(seed: int) -> list[list[int]]:
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(len(ONLINE_FEATURES), SUBSPACE, replace=False).tolist()) for _ in range(MEMBERS)]


@dataclass
class OnlineModel:
    """Trees and error windows of all members."""

    seed: int = 42
    updates: int = 0
    replaced: int = 0
    trees: list[Tree] | None = None
    windows: list[Window] | None = None

    def __post_init__(self):
        if self.trees is None:
            self.trees = [Tree(own) for own in _subspaces(self.seed)]
            self.windows = [Window() for _ in self.trees]

    def probability(self) -> Column:
        """Mean of the members' probabilities, as a vectorised column."""
        trees = self.trees

        @F.pandas_udf("double")
        def said(inputs: pd.DataFrame) -> pd.Series:
            bins = _bins(inputs)
            return pd.Series(np.mean([t.probability()[t.leaf(bins)] for t in trees], axis=0))

        return said(F.struct(*_inputs()))

    def sums(self, batch: DataFrame, key: str = "transactionId", label: str = "label") -> DataFrame:
        """member, kind, leaf, feature, bin, label and n: what the batch teaches; rows add up over batches.

        Kind ``leaf`` counts seen rows by leaf, own feature and bin, ``root`` the
        same for a tree of one leaf, and ``error`` rows (label 0) and errors (label 1)
        of the member before it learns.
        """
        trees, seed = self.trees, self.seed

        def work(frames):
            for frame in frames:
                bins, y = _bins(frame), frame["_label"].to_numpy().astype(np.int64)
                keys = frame["_key"].to_numpy().astype(np.int64).view(np.uint64)
                for member, tree in enumerate(trees):
                    weight, leaf = copies(keys, member, seed), tree.leaf(bins)
                    wrong = (tree.probability()[leaf] >= 0.5) != (y == 1)
                    rows = [(member, "error", 0, 0, 0, 0, len(y)), (member, "error", 0, 0, 0, 1, int(wrong.sum()))]
                    for own, column in enumerate(tree.features):
                        for kind, at in (("leaf", leaf), ("root", np.zeros_like(leaf))):
                            cell = (at * BINS + bins[:, column]) * 2 + y
                            n = np.bincount(cell, weights=weight).astype(np.int64)
                            rows += [(member, kind, int(c // (2 * BINS)), own, int(c // 2 % BINS), int(c % 2), int(n[c])) for c in np.flatnonzero(n)]
                    yield pd.DataFrame(rows, columns=["member", "kind", "leaf", "feature", "bin", "label", "n"])

        read = batch.select(*_inputs(), F.col(label).cast("int").alias("_label"), F.xxhash64(key).alias("_key"))
        told = read.mapInPandas(work, "member int, kind string, leaf int, feature int, bin int, label int, n long")
        return told.groupBy("member", "kind", "leaf", "feature", "bin", "label").agg(F.sum("n").alias("n"))

    def learned(self, rows: list) -> "OnlineModel":
        """The next model, from the sums of a batch."""
        after = OnlineModel.load(self.dump())
        tables: dict[tuple, np.ndarray] = {}
        for r in rows:
            table = tables.setdefault((r["member"], r["kind"], r["leaf"]), np.zeros((SUBSPACE, BINS, 2)))
            table[r["feature"], r["bin"], r["label"]] += r["n"]
        for member in range(len(after.trees)):
            seen = tables.get((member, "error", 0))
            if seen is None:
                continue
            n, wrong = int(seen[0, 0, 0]), float(seen[0, 0, 1])
            after.updates += n if member == 0 else 0
            # A tree that has seen nothing has made no prediction that could be wrong.
            fresh = sum(self.trees[member].counts[0]) == 0
            if not fresh and after.windows[member].add(n, wrong):
                after.trees[member] = Tree(after.trees[member].features)
                after.replaced += 1
                if (member, "root", 0) in tables:
                    after.trees[member].add(0, tables[member, "root", 0])
                continue
            for (of, kind, leaf), table in sorted(tables.items()):
                if of == member and kind == "leaf":
                    after.trees[member].add(leaf, table)
        return after

    def learn(self, batch: DataFrame, key: str = "transactionId", label: str = "label") -> "OnlineModel":
        """One micro-batch; a batch without rows changes nothing."""
        return self.learned(self.sums(batch, key, label).collect())  # the model's size at most

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str) -> "OnlineModel":
        read = json.loads(text)
        return OnlineModel(read["seed"], read["updates"], read["replaced"], [Tree(**t) for t in read["trees"]],
                           [Window(**w) for w in read["windows"]])


def _inputs() -> list[Column]:
    """Model inputs scaled to about one (the panel size is at most ten)."""
    return [(F.col(n) / 10.0 if n == "agent_consensus" else F.col(n)).cast("double").alias(f"_{n}") for n in ONLINE_FEATURES]


def _bins(inputs: pd.DataFrame) -> np.ndarray:
    """Bin of each input; what is missing counts as 0, what lies outside 0 to 1 as the nearest end."""
    x = np.nan_to_num(inputs[[f"_{n}" for n in ONLINE_FEATURES]].to_numpy(dtype=float), nan=0.0)
    return np.clip((np.clip(x, 0, 1) * BINS).astype(np.int64), 0, BINS - 1)


def learn_in_steps(labelled: DataFrame, step: str, steps: list, write, model: OnlineModel | None = None,
                   reference_order: bool = False) -> OnlineModel:
    """Walk the steps in order: ``write(scored, number)`` stores each one's scored rows, then the model learns.

    ``reference_order`` scores after learning. ``labelled`` is read once a step
    and so is best a written table divided by the step.
    """
    model = model or OnlineModel()
    for number, value in enumerate(steps):
        batch = labelled.where(F.col(step) == F.lit(value))
        after = model.learn(batch)
        judge = after if reference_order else model
        write(batch.withColumn("onlineScore", judge.probability()), number)
        model = after
    return model
