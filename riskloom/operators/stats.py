"""Feature statistics, drift and classifier metrics, without unbounded groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.ordered import running_totals

# The statistics kept per feature and window.
QUANTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def long_features(df: DataFrame, features: list[str], extra: list[str]) -> DataFrame:
    """One row per (row, feature); partial aggregation folds these map-side."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("feature_name"), F.col(f).cast("double").alias("value")) for f in features
    ])
    return df.select(*extra, F.inline(pairs))


def value_ranges(value: Column) -> Column:
    """Ranges that never fall as the value goes up: 4,096 between 0 and 1, as many per doubling beyond."""
    size = F.floor(F.log2(F.abs(value) + 1.0) * 4096)
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).otherwise(F.when(value < 0, -size).otherwise(size))


def exact_quantiles(long: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group from counts of distinct values.

    Rows are first reduced to (group, value, count), so no task holds a
    group's rows; ranks come from a running total over those counts.
    """
    counts = long.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    ranked = running_totals(
        counts, keys, ["value"], {"upto": F.col("c")}, value_ranges(F.col("value"))).join(sizes, keys)

    def at(rank: Column) -> Column:
        inside = (rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto"))
        return F.max(F.when(inside, F.col("value")))

    picks = {}
    for name, q in quantiles.items():
        place = (F.col("n") - 1) * F.lit(q)
        picks[f"{name}_lo"], picks[f"{name}_hi"] = at(F.floor(place)), at(F.ceil(place))
    found = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[v.alias(k) for k, v in picks.items()])
    result = []
    for name, q in quantiles.items():
        place = (F.col("n") - 1) * F.lit(q)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        result.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return found.select(*keys, *result)


def feature_stats(df: DataFrame, features: list[str], size: str = "1 day", time: str = "timestamp") -> DataFrame:
    """(feature_name, stat_type, stat_value, sample_count, window_start, window_end)."""
    windowed = df.withColumn("w", F.window(time, size)).withColumns(
        {"window_start": F.col("w.start"), "window_end": F.col("w.end")})
    keys = ["feature_name", "window_start", "window_end"]
    long = long_features(windowed, features, ["window_start", "window_end"])
    moments = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("value").alias("mean"), F.stddev("value").alias("stddev"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg(F.col("value").isNull().cast("double")).alias("null_rate"),
    )
    wide = moments.join(exact_quantiles(long, keys, QUANTILES), keys, "left").withColumn("median", F.col("p50"))
    names = ["mean", "stddev", "median", *QUANTILES, "min", "max", "null_rate"]
    pairs = F.array(*[F.struct(F.lit(n).alias("stat_type"), F.col(n).alias("stat_value")) for n in names])
    return wide.select("feature_name", "window_start", "window_end", "sample_count", F.inline(pairs))


def feature_drift(current: DataFrame, baseline: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """Mean shift in baseline deviations, and population stability index.

    Bins are equal widths between the baseline's extremes; the outer bins are
    open. Both frames are scanned once for moments and once for bin counts.
    """
    def moments(df: DataFrame, tag: str) -> DataFrame:
        return long_features(df, features, []).groupBy("feature_name").agg(
            F.count("value").alias(f"{tag}_count"), F.avg("value").alias(f"{tag}_mean"),
            F.stddev("value").alias(f"{tag}_std"), F.min("value").alias(f"{tag}_min"),
            F.max("value").alias(f"{tag}_max"))

    base, now = moments(baseline, "baseline"), moments(current, "current")
    width = F.col("baseline_max") - F.col("baseline_min")
    place = F.floor(F.try_divide((F.col("value") - F.col("baseline_min")) * bins, width))
    bucket = F.coalesce(F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)), F.lit(0)).cast("int")

    def binned(df: DataFrame, tag: str) -> DataFrame:
        edges = base.select("feature_name", "baseline_min", "baseline_max")
        rows = long_features(df, features, []).where(F.col("value").isNotNull())
        # Fold equal values first, so the join sees distinct values only.
        folded = rows.groupBy("feature_name", "value").agg(F.count(F.lit(1)).alias("c"))
        return folded.join(edges, "feature_name").groupBy("feature_name", bucket.alias("bin")).agg(
            F.sum("c").alias(f"{tag}_n"))

    floor = F.lit(1e-6)
    shares = binned(baseline, "baseline").join(binned(current, "current"), ["feature_name", "bin"], "full_outer")
    totals = base.join(now, "feature_name")
    expected = F.greatest(floor, F.coalesce(F.col("baseline_n") / F.col("baseline_count"), F.lit(0.0)))
    actual = F.greatest(floor, F.coalesce(F.col("current_n") / F.col("current_count"), F.lit(0.0)))
    psi = shares.join(totals.select("feature_name", "baseline_count", "current_count"), "feature_name").groupBy(
        "feature_name").agg(F.sum((actual - expected) * F.log(actual / expected)).alias("psi"))
    shift = F.try_divide(F.col("current_mean") - F.col("baseline_mean"), F.nullif(F.col("baseline_std"), F.lit(0.0)))
    return totals.join(psi, "feature_name").select(
        "feature_name", "baseline_mean", "current_mean", "baseline_std", shift.alias("z_shift"), "psi")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve with tied scores averaged, as one row.

    Scores are folded to (score, positives, negatives) before ranking.
    """
    return _ranked_scores(df, score, label).agg(_area().alias("auc"))


def _ranked_scores(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg, neg_upto), one row per distinct score."""
    positive = F.col(label).cast("int")
    folded = df.groupBy(F.col(score).alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    return running_totals(folded, [], ["score"], {"neg_upto": F.col("neg")}, value_ranges(F.col("score")))


def _area() -> Column:
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double"))


def confusion(df: DataFrame, score: str, label: str, cut: float = 0.5) -> DataFrame:
    said, truth = F.col(score) >= cut, F.col(label).cast("int") == 1
    return df.agg(
        F.count(F.when(said & truth, 1)).alias("tp"), F.count(F.when(said & ~truth, 1)).alias("fp"),
        F.count(F.when(~said & truth, 1)).alias("fn"), F.count(F.when(~said & ~truth, 1)).alias("tn"))


def class_report(df: DataFrame, score: str, label: str, cut: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    return confusion(df, score, label, cut).select(F.inline(_class_rows()))


def _class_rows() -> Column:
    """One struct per class from the counts tp, fp, fn and tn."""
    def row(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        zero = F.lit(0.0)
        precision = F.coalesce(F.try_divide(hit.cast("double"), hit + wrong), zero)
        recall = F.coalesce(F.try_divide(hit.cast("double"), hit + missed), zero)
        f1 = F.coalesce(F.try_divide(precision * recall * 2, precision + recall), zero)
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), (hit + missed).alias("support"))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return F.array(row("fraud", tp, fp, fn), row("legitimate", tn, fn, fp))


def binary_metrics(df: DataFrame, score: str, label: str, cut: float = 0.5) -> DataFrame:
    """Per-class report with the AUC beside it, both from one fold of the rows by score."""
    said = F.col("score") >= cut

    def count(said: Column, of: str) -> Column:
        return F.coalesce(F.sum(F.when(said, F.col(of))), F.lit(0))

    counts = _ranked_scores(df, score, label).agg(
        count(said, "pos").alias("tp"), count(said, "neg").alias("fp"),
        count(~said, "pos").alias("fn"), count(~said, "neg").alias("tn"), _area().alias("auc"))
    return counts.select(F.inline(_class_rows()), "auc")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("fraud_rate"))


def running_auc(df: DataFrame, score: str, label: str, step: str) -> DataFrame:
    """AUC over everything seen up to each step, by counting what each step adds.

    Rows fold to counts per (step, score). A positive row wins against the
    negative ones of smaller score in its own and earlier steps, a negative row
    loses to the positive ones of larger score in earlier steps. Those are
    counted by divide and prefix: on every bit of the step's place, blocks of
    steps fall into an earlier and a later half, and a running total over the
    score counts the earlier half for the rows of the later one. Two steps part
    on exactly one bit, so each folded row is looked at once a bit, whatever the
    number of steps.
    """
    positive = F.col(label).cast("int")
    folded = df.groupBy(F.col(step).alias("step"), F.col(score).alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    steps = folded.groupBy(F.col("step").alias("_step")).agg(F.sum("pos").alias("step_pos"), F.sum("neg").alias("step_neg"))
    whole = Window.orderBy("_step")  # one row a step
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    # Always true; it reads the sums, so that every use of ``folded`` has the same columns and Spark makes it once.
    placed = steps.where(F.coalesce(F.col("step_pos") + F.col("step_neg"), F.lit(0)) >= 0).withColumns({
        "place": F.row_number().over(whole) - 1, "pos_upto": F.sum("step_pos").over(upto), "neg_upto": F.sum("step_neg").over(upto),
        "bits": F.ceil(F.log2(F.count("*").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).cast("int")})
    known = folded.join(placed.select("_step", "place", "bits"), F.col("step").eqNullSafe(F.col("_step")))
    # Bit -1 is the step itself: its rows are both sides, and only positive ones are asked.
    rows = known.select("step", "score", "pos", "neg", "place", F.explode(F.sequence(F.lit(-1), F.col("bits") - 1)).alias("bit"))
    own, half = F.col("bit") < 0, F.expr("shiftright(place, greatest(bit, 0)) & 1")
    rows = rows.withColumns({
        "block": F.expr("shiftright(place, bit + 1)"), "later": own | (half == 1), "range": value_ranges(F.col("score")),
        "left_neg": F.when(own | (half == 0), F.col("neg")).otherwise(0), "left_pos": F.when(~own & (half == 0), F.col("pos")).otherwise(0)})
    keys, sides = ["bit", "block"], ["left_neg", "left_pos"]
    ranges = rows.groupBy(*keys, "range").agg(*[F.sum(c).alias(c) for c in sides])
    block = Window.partitionBy(*keys)
    before = block.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        *[F.col(k).alias(f"_{k}") for k in [*keys, "range"]], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sides],
        F.sum("left_pos").over(block).alias("left_pos_all"))
    met = rows.join(offsets, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "range"]])
    inside = Window.partitionBy(*keys, "range").orderBy("score")
    smaller, equal = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow), inside.rangeBetween(Window.currentRow, Window.currentRow)
    met = met.withColumns({f"{c}_upto": F.sum(c).over(smaller) + F.col(f"{c}_before") for c in sides} | {f"{c}_same": F.sum(c).over(equal) for c in sides})
    # Twice the wins, so that ties stay whole numbers.
    gained = F.col("pos") * (2 * F.col("left_neg_upto") - F.col("left_neg_same"))
    lost = F.when(own, 0).otherwise(F.col("neg") * (2 * (F.col("left_pos_all") - F.col("left_pos_upto")) + F.col("left_pos_same")))
    wins = met.filter("later").groupBy("step").agg(F.sum(gained + lost).alias("wins"))
    total = placed.join(wins, F.col("step").eqNullSafe(F.col("_step")))
    return total.select(
        "step", (F.col("pos_upto") + F.col("neg_upto")).alias("updates"),
        F.try_divide(F.sum("wins").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)) / 2,
                     (F.col("pos_upto") * F.col("neg_upto")).cast("double")).alias("auc"))
