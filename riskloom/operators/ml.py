"""Scoring models: splits, scaling, boosted trees, attributions, persistence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import settings as S
from riskloom.operators.ordered import running_totals


# --- splits and scaling ---------------------------------------------------

def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, salt: str = "42") -> DataFrame:
    """Append ``isTest``: exactly round(share × size) rows of each class, repeatably.

    Rows are ordered by a hash of the key. A class may hold most of the
    table, so the ranks come from :func:`running_totals`.
    """
    drawn = df.withColumn("_draw", F.md5(F.concat(F.col(key).cast("string"), F.lit(salt))))
    ranked = running_totals(drawn, [label], ["_draw", key], {"_place": F.lit(1).cast("long")},
                            ranges=F.substring("_draw", 1, 4))
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_size"))
    joined = ranked.join(sizes, ranked[label].eqNullSafe(sizes["_label"]), "left")
    return joined.withColumn("isTest", F.col("_place") <= F.floor(F.col("_size") * test_share + 0.5)).drop(
        "_draw", "_place", "_label", "_size")


@dataclass(frozen=True)
class Scaler:
    """Per-feature mean and population deviation (0 reads as 1)."""

    means: dict[str, float]
    deviations: dict[str, float]

    def columns(self) -> dict[str, Column]:
        return {f: (F.col(f) - F.lit(self.means[f])) / F.lit(self.deviations[f]) for f in self.means}


def fit_scaler(train: DataFrame, features: list[str] = S.FEATURES) -> Scaler:
    """One aggregation pass; the fitted model is two numbers per feature."""
    row = train.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                    *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return Scaler({f: row[f"m_{f}"] for f in features}, {f: row[f"s_{f}"] or 1.0 for f in features})


# --- linear scores, exactly attributable ------------------------------------

@dataclass(frozen=True)
class LinearModel:
    """Logistic score over features, with exact additive attributions."""

    coefficients: dict[str, float]
    intercept: float

    def probability(self, digits: int = 4) -> Column:
        margin = " + ".join([f"{self.intercept}D", *(f"{w}D * {name}" for name, w in self.coefficients.items())])
        return F.expr(f"round(1D / (1D + exp(-({margin}))), {digits})")

    def contributions(self, means: dict[str, float] | str) -> Column:
        """``array<struct<feature,value>>``: coefficient times distance from the mean.

        ``means`` holds the numbers, or names a struct column that does.
        """
        mean = {name: f"{means}.{name}" if isinstance(means, str) else f"{float(means[name])!r}D" for name in self.coefficients}
        parts = [f"named_struct('feature', '{name}', 'value', {weight}D * ({name} - {mean[name]}))"
                 for name, weight in self.coefficients.items()]
        return F.expr(f"array({', '.join(parts)})")


def feature_means(df: DataFrame, features: list[str]) -> dict[str, float]:
    return df.agg(*[F.avg(f).alias(f) for f in features]).first().asDict()


def with_attributions(df: DataFrame, model: LinearModel, output: str = "topFeatures", over: DataFrame | None = None) -> DataFrame:
    """Append the largest contributions to a linear score.

    The means are a scalar subquery over the same rows (or ``over``, which has
    them with fewer columns), so nothing runs until a result that needs them is read.
    """
    averages = ", ".join(f"'{name}', avg({name})" for name in model.coefficients)
    centred = df.withColumn("_means", (df if over is None else over).agg(F.expr(f"named_struct({averages})").alias("means")).scalar())
    return centred.withColumn(output, top_attributions(model.contributions("_means"))).drop("_means")


def top_attributions(contributions: Column, keep: int = 3) -> Column:
    """The ``keep`` entries of largest magnitude, sign kept; ties by name."""
    ranked = F.transform(contributions, lambda c: F.struct(
        (-F.round(F.abs(c["value"]), 9)).alias("order"), c["feature"].alias("feature"), c["value"].alias("value")))
    return F.transform(F.slice(F.sort_array(ranked), 1, keep), lambda c: F.struct(
        c["feature"].alias("feature"), c["value"].alias("value")))


# --- boosted trees ----------------------------------------------------------

def assembler(features: list[str], output: str = "rawFeatures") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=output, handleInvalid="keep")


def train_classifier(train: DataFrame, label: str = "label", features: list[str] = S.FEATURES, *,
                     trees: int = 200, depth: int = 6, rate: float = 0.1, positive_weight: float = 4.0,
                     sampling: float = 0.8, seed: int = 42) -> PipelineModel:
    """Assemble, standardise (fitted on these rows only) and boost."""
    weighted = train.withColumns({
        "_weight": F.when(F.col(label) == 1, positive_weight).otherwise(1.0),
        "_label": F.col(label).cast("double"),
    })
    booster = GBTClassifier(
        featuresCol="features", labelCol="_label", weightCol="_weight", maxIter=trees, maxDepth=depth,
        stepSize=rate, subsamplingRate=sampling, featureSubsetStrategy=str(sampling), seed=seed)
    scaler = StandardScaler(inputCol="rawFeatures", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[assembler(features), scaler, booster]).fit(weighted)


def score(model: PipelineModel | None, df: DataFrame, output: str = "mlFraudScore") -> DataFrame:
    """P(fraud) per row. Without a model the rows are skipped, not failed."""
    if model is None:
        return df.withColumn(output, F.lit(None).cast("double")).where(F.lit(False))
    added = ["rawFeatures", "features", "rawPrediction", "probability", "prediction"]
    return model.transform(df).withColumn(output, vector_to_array("probability")[1]).drop(*added)


def feature_importance(model: PipelineModel, spark: SparkSession, features: list[str] = S.FEATURES,
                       limit: int = 5) -> DataFrame:
    booster = model.stages[-1]
    assert isinstance(booster, GBTClassificationModel)
    values = [(name, float(v)) for name, v in zip(features, booster.featureImportances.toArray())]
    return spark.createDataFrame(values, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(limit)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """The stored model, or None when there is none yet."""
    spark = SparkSession.getActiveSession()
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return PipelineModel.load(path) if files.exists(location) else None


# --- text vectors -----------------------------------------------------------

def fit_text_embedder(documents: DataFrame, column: str = "document", size: int = 384) -> PipelineModel:
    """Hashed term weights, normalised: stands in where no encoder is installed."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol=column, outputCol="_words", pattern=r"[^\p{L}\p{N}_./]+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=size),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(documents)


def embed_text(df: DataFrame, column: str, embedder: PipelineModel | None = None, encoder=None,
               output: str = "embedding") -> DataFrame:
    """Append ``array<float>`` vectors from the fitted embedder or a vectorised encoder.

    ``encoder`` is a pandas UDF from text to ``array<float>``.
    """
    if encoder is not None:
        return df.withColumn(output, encoder(F.col(column)))
    source = embedder.stages[0].getInputCol()
    made = embedder.transform(df.withColumn(source, F.col(column)) if source != column else df)
    result = made.withColumn(output, vector_to_array("_unit", dtype="float32"))
    drop = ["_words", "_counts", "_weighted", "_unit"] + ([source] if source != column else [])
    return result.drop(*drop)
