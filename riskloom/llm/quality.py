"""Quality by hierarchical empirical Bayes.

Three pieces of evidence meet on the log-odds scale: a document classifier
(logistic regression on the shape of the text), the posterior of the host and
the posterior of the path below it. Posteriors are Beta-binomial: the global
rate is the prior of every host, a host's posterior mean is the prior of its
paths, and each level's prior strength comes from the spread of its groups by
the method of moments. Sparse groups therefore stay near their parent. All
counts are grouped aggregates over all labelled rows of the learning folds.

The classifier is fitted on a bounded sample (``TRAIN_ROWS`` of each class,
picked by a hash of the id) and its intercept set to the global rate.

Defined results: null and empty texts have all measures 0; null hosts and paths
are groups of their own; unseen groups take their parent's posterior; without
labels of both classes the classifier is silent.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WordTable, claim, held_out, kept, logistic_fit, map_rows, small

#: Bound of the classifier's sample, rows of each class.
TRAIN_ROWS = 3000
#: Prior strength stays between these numbers of rows.
STRENGTH = (1.0, 1e6)
MEASURES = ("log_words", "upper_share", "symbol_share", "digit_share", "word_length", "repeated_share",
            "same_as_before", "symbol_words", "long_words")


def _measure(word: str) -> tuple[int, ...]:
    letters = sum(map(str.isalpha, word))
    digits = sum(map(str.isdigit, word))
    return (len(word), letters, sum(map(str.isupper, word)), digits, len(word) - letters - digits,
            int(letters + digits == 0), int(len(word) > 25))


@lru_cache(maxsize=1)
def _words() -> WordTable:
    return WordTable(_measure, 7)


def measures(text: str | None) -> list[float]:
    """The classifier's view of a whole text."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(MEASURES)
    size, letters, upper, digits, symbols, bare, long = (float(v) for v in _words().totals(words))
    n = len(words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [float(np.log1p(n)), upper / max(letters, 1.0), symbols / size, digits / size, size / n,
            1 - len(set(words)) / n, same / n, bare / n, long / n]


def with_measures(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and the measures; texts go no further."""

    def work(batches):
        claim(_words())
        for batch in batches:
            x = pa.array([measures(t) for t in batch.column(3).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], x], ["doc_id", "host", "path", "x"])

    read = docs.select(F.col("doc_id").cast("long"), host.alias("host"), path.alias("path"), "text")
    return map_rows(read, work, "doc_id long, host string, path string, x array<double>")


def _strength(groups: DataFrame, good: str, n: str, mean: str) -> Column:
    """Prior rows by moments: the spread of group rates beyond sampling noise around their prior mean."""
    rate = F.col(good) / F.col(n)
    spread = F.sum(F.col(n) * (rate - F.col(mean)) ** 2) / F.sum(n)
    noise = F.sum(F.col(mean) * (1 - F.col(mean))) / F.sum(n)
    within = F.sum(F.col(n) * F.col(mean) * (1 - F.col(mean))) / F.sum(n)
    between = F.greatest(spread - noise, F.lit(1e-9))
    return F.least(F.greatest(within / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias("strength")


def posteriors(labelled: DataFrame) -> tuple[float, DataFrame, DataFrame]:
    """Global rate, host posteriors (host, host_rate) and path posteriors (host, path, path_rate).

    Reads host, path and good (0/1); groups are pre-aggregated before they are
    shuffled, so a host with a third of all rows is one row per task.
    """
    paths = kept(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("k")))
    whole = paths.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    rate = ((whole["k"] or 0) + 1.0) / ((whole["n"] or 0) + 2.0)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("mean", F.lit(rate))
    host_strength = hosts.agg(_strength(hosts, "k", "n", "mean")).first()["strength"] or STRENGTH[1]
    hosts = kept(hosts.select(F.col("host").alias("_host"),
                              ((F.col("k") + host_strength * rate) / (F.col("n") + host_strength)).alias("host_rate")))
    below = paths.join(small(hosts), F.col("host").eqNullSafe(F.col("_host"))).withColumn("mean", F.col("host_rate"))
    path_strength = below.agg(_strength(below, "k", "n", "mean")).first()["strength"] or STRENGTH[1]
    below = below.select(F.col("host").alias("_host"), F.col("path").alias("_path"), (
        (F.col("k") + path_strength * F.col("mean")) / (F.col("n") + path_strength)).alias("path_rate"))
    return rate, hosts, kept(below)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, document evidence, host and path posteriors, score and predicted."""
    spark = docs.sparkSession
    measured = kept(with_measures(docs, host, path))
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").alias("_id")).agg(F.max("quality").alias("good"))
    labelled = kept(measured.dropDuplicates(["doc_id"]).join(known, F.col("doc_id") == F.col("_id")).drop("_id"))
    rate, hosts, paths = posteriors(labelled)
    sample = [r for k in (0, 1) for r in labelled.filter(F.col("good") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(
        rows).select("x", "good").collect()]
    y = np.array([r["good"] for r in sample], float)
    weights, centre, scale = np.zeros(len(MEASURES) + 1), np.zeros(len(MEASURES)), np.ones(len(MEASURES))
    if 0 < y.sum() < len(y):
        x = np.array([r["x"] for r in sample])
        centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        weights = logistic_fit((x - centre) / scale, y)
        weights[-1] -= np.log(y.mean() / (1 - y.mean()))  # evidence only; the prior comes from the hierarchy
    terms = [F.lit(float(w)) * (F.col("x")[k] - float(c)) / float(s)
             for k, (w, c, s) in enumerate(zip(weights, centre, scale))]
    evidence = F.lit(float(weights[-1]))
    for term in terms:
        evidence = evidence + term
    placed = measured.join(small(hosts), F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host").join(
        small(paths), F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    host_rate = F.coalesce("host_rate", F.lit(rate))
    path_rate = F.coalesce("path_rate", host_rate)
    odds = F.greatest(F.least(F.col("evidence") + _logit(F.col("path_rate")), F.lit(30.0)), F.lit(-30.0))
    out = placed.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), evidence.alias("evidence"),
                        host_rate.alias("host_rate"), path_rate.alias("path_rate")).withColumn(
        "score", 1 / (1 + F.exp(-odds)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
