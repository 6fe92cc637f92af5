"""Failure-risk models on ``pyspark.ml``: training, comparison, storage and serving."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rigsense import schema as S
from rigsense.functions.exprs import lit_d
from rigsense.operators import evaluate, scoring
from rigsense.operators.features import feature_set, serving_snapshot
from rigsense.operators.fleet import with_latest_context
from rigsense.operators.scale import materialize
from rigsense.plans.boosting import HistogramBoosting
from rigsense.plans.forest import HistogramForest

CONTEXT = [
    "timestamp", "miner_id", "operating_mode", S.TARGET, "asic_temperature_c",
    "power_instability_index", "hashrate_degradation_pct_12h", "te_drift_pct_4h",
]


# --------------------------------------------------------------------------- preparation
def prepare_stages(train: DataFrame, numeric: Sequence[str] = tuple(S.NUMERIC_FEATURES)) -> list:
    """Median imputation and standardizing; most frequent mode and one-hot, unknown as zeros."""
    top = train.groupBy("operating_mode").count().filter("operating_mode is not null").orderBy(
        F.col("count").desc(), "operating_mode").first()
    common = (top["operating_mode"] if top else "normal").replace("'", "''")
    filled = [f"{c}__filled" for c in numeric]
    return [
        SQLTransformer(statement=(
            f"SELECT *, coalesce(operating_mode, '{common}') AS mode__filled FROM __THIS__")),
        Imputer(strategy="median", inputCols=list(numeric), outputCols=filled, relativeError=1e-4),
        VectorAssembler(inputCols=filled, outputCol="numeric__raw", handleInvalid="keep"),
        StandardScaler(inputCol="numeric__raw", outputCol="numeric__scaled", withMean=True),
        # Unknown modes get the extra last index, which dropLast turns into all zeros.
        StringIndexer(inputCol="mode__filled", outputCol="mode__index", handleInvalid="keep"),
        OneHotEncoder(inputCol="mode__index", outputCol="mode__onehot"),
        VectorAssembler(inputCols=["numeric__scaled", "mode__onehot"], outputCol="features"),
    ]


def with_weights(df: DataFrame, weights, label: str = S.TARGET) -> DataFrame:
    """Balanced class weights and the positive-class scale as columns."""
    y = F.col(label) == 1
    return df.withColumns({
        "label": F.col(label).cast("double"),
        "balanced_weight": F.when(y, lit_d(weights["weight_pos"] or 1.0)).otherwise(lit_d(weights["weight_neg"] or 1.0)),
        "scaled_weight": F.when(y, lit_d(weights["scale_pos_weight"])).otherwise(lit_d(1.0)),
    })


def logistic(total_weight: float) -> LogisticRegression:
    """L2 with unit inverse strength: Spark averages the loss, so the penalty is divided too."""
    return LogisticRegression(
        weightCol="balanced_weight", regParam=1.0 / max(total_weight, 1.0), elasticNetParam=0.0,
        standardization=False, maxIter=1200)


def forest(trees: int = 300, depth: int = 12, leaf: int = 5) -> HistogramForest:
    return HistogramForest(trees, depth, leaf, weight="balanced_weight")


def boosted(rounds: int = 400, depth: int = 8, rate: float = 0.05) -> HistogramBoosting:
    return HistogramBoosting(rounds, depth, rate, weight="scaled_weight")


def fit(train: DataFrame, estimator) -> PipelineModel:
    return Pipeline(stages=[*prepare_stages(train), estimator]).fit(train)


def with_score(model: PipelineModel, df: DataFrame, columns: Sequence[str] = tuple(S.NUMERIC_FEATURES)) -> DataFrame:
    """Add ``risk_score``; columns that the model was fitted on and ``df`` lacks are added as NULL."""
    absent = [c for c in columns if c not in df.columns and c not in S.CATEGORICAL_FEATURES]
    full = df.withColumns({c: F.lit(None).cast("double") for c in absent})
    if "operating_mode" not in full.columns:
        full = full.withColumn("operating_mode", F.lit(None).cast("string"))
    scored = model.transform(full)
    return scored.withColumn("risk_score", F.get(vector_to_array("probability"), F.lit(1))).select(
        *df.columns, "risk_score")


# --------------------------------------------------------------------------- training
def split(features: DataFrame, q: float = 0.80) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows; both are written once, as every fit reads them many times."""
    tagged = scoring.time_split(features.filter(F.col("timestamp").isNotNull()), q)
    train = materialize(tagged.filter("is_train").drop("is_train"), "train")
    valid = materialize(tagged.filter("not is_train").drop("is_train"), "valid")
    if train.isEmpty() or valid.isEmpty():
        raise ValueError("no rows on one side of the time split")
    return train, valid


def default_models(n_rows: int) -> dict[str, Callable]:
    return {
        "logistic_regression": lambda: logistic(float(n_rows)),
        "random_forest": forest,
        "gradient_boosting": boosted,
    }


def train_and_compare(features: DataFrame, models: dict[str, Callable] | None = None, shifted: bool = False) -> dict:
    """Fit each model and keep the one with the best F1 at its optimal threshold, then PR-AUC.

    Returns the fitted models, the comparison DataFrame, the best name and its threshold, and
    the scored validation rows of each model.
    """
    train, valid = split(features)
    weights = scoring.class_weights(train).first()
    n_rows = weights["n_neg"] + weights["n_pos"]
    weighted = with_weights(train, weights)
    ready = Pipeline(stages=prepare_stages(weighted)).fit(weighted)  # the same for every model
    prepared = ready.transform(weighted)
    fitted, scored, reports = {}, {}, []
    for name, make in (models or default_models(n_rows)).items():
        fitted[name] = PipelineModel(stages=[*ready.stages, make().fit(prepared)])
        scored[name] = materialize(
            with_score(fitted[name], valid).select(*[c for c in CONTEXT], "risk_score"), f"scored-{name}")
        reports.append(evaluate.model_evaluation(scored[name], shifted).withColumn("model", F.lit(name)))
    table = reports[0]
    for r in reports[1:]:
        table = table.unionByName(r)
    comparison = table.sparkSession.createDataFrame(table.collect(), table.schema)  # three rows per model
    best = model_select(comparison).first()
    return {
        "models": fitted, "scored": scored, "comparison": comparison, "best": best["model"],
        "threshold": best["threshold"], "train_rows": n_rows, "valid_rows": valid.count(),
    }


def model_select(comparison: DataFrame) -> DataFrame:
    """The winning model with its threshold, as one row."""
    return comparison.filter("part = 'optimal_threshold_metrics'").orderBy(
        F.col("f1").desc(), F.col("pr_auc").desc(), "model").limit(1).select("model", "threshold", "f1", "pr_auc")


def feature_importance(model: PipelineModel, spark: SparkSession, top: int = 25) -> DataFrame:
    """Tree importances or absolute coefficients, largest first. Small: one row per feature."""
    estimator = model.stages[-1]
    values = (
        estimator.featureImportances if hasattr(estimator, "featureImportances") else estimator.coefficients
    ).toArray()
    modes = next(s for s in model.stages if hasattr(s, "labels")).labels
    names = [f"num__{c}" for c in S.NUMERIC_FEATURES] + [f"cat__operating_mode_{m}" for m in modes]
    rows = [(n, float(abs(v))) for n, v in zip(names, values)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(top)


def save_model(result: dict, features: DataFrame, path: str, as_of: datetime) -> None:
    """The winning pipeline, the comparison of all models, and one metadata row."""
    result["models"][result["best"]].write().overwrite().save(f"{path}/model")
    meta = scoring.cooling_ratio(features).withColumns({
        "model_name": F.lit(result["best"]), "threshold": lit_d(result["threshold"]),
        "feature_columns": F.lit(",".join(S.NUMERIC_FEATURES + S.CATEGORICAL_FEATURES)),
        "target_column": F.lit(S.TARGET), "trained_at": F.lit(as_of),
    })
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    result["comparison"].coalesce(1).write.mode("overwrite").parquet(f"{path}/comparison")


def load_comparison(spark: SparkSession, path: str) -> DataFrame:
    """The model comparison of a stored run."""
    return spark.read.parquet(f"{path}/comparison")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    meta = spark.read.json(f"{path}/meta").first().asDict()
    return PipelineModel.load(f"{path}/model"), meta


# --------------------------------------------------------------------------- serving
def score_model(
    kpi: DataFrame, as_of: datetime, path: str | None = None, lookback_hours: float = 24,
    threshold: float = 0.55, cooling_ratio: float = S.COOLING_RATIO,
) -> DataFrame:
    """Risk of each device seen in the lookback; the heuristic when there is no usable model."""
    model = None
    if path is not None:
        try:
            model, meta = load_model(kpi.sparkSession, path)
            cooling_ratio = max(float(meta.get("cooling_power_ratio", cooling_ratio)), 0.0)
            columns = [c for c in meta.get("feature_columns", "").split(",") if c] or S.NUMERIC_FEATURES
        except AnalysisException as error:  # only an artifact that is not there
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if model is None:
        return scoring.risk_heuristic(kpi, threshold)
    recent = kpi.filter(
        (F.col("timestamp") >= F.lit(as_of - timedelta(hours=lookback_hours))) & (F.col("timestamp") <= F.lit(as_of)))
    snapshot = with_latest_context(serving_snapshot(recent, cooling_ratio=cooling_ratio), recent)
    score = F.col("risk_score")
    return with_score(model, snapshot, columns).withColumns({
        "risk_band": scoring.risk_band(score, S.BANDS_WORKER), "predicted_failure": score >= lit_d(threshold)})


def retrain_guard(
    kpi: DataFrame, as_of: datetime, days: int = 30, min_rows: int = 500, min_devices: int = 10, min_hours: float = 72.0
) -> DataFrame:
    """Whether the last days hold enough data to retrain, and if not, why; one aggregate."""
    recent = kpi.filter((F.col("timestamp") >= F.lit(as_of - timedelta(days=days))) & (F.col("timestamp") <= F.lit(as_of)))
    row = recent.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("miner_id").alias("n_miners"),
        F.coalesce((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / lit_d(3.6e9), lit_d(0.0))
        .alias("span_hours"))
    reason = (
        F.when(F.col("n_rows") < min_rows, F.lit("not_enough_rows"))
        .when(F.col("n_miners") < min_devices, F.lit("not_enough_miners"))
        .when(F.col("span_hours") < lit_d(min_hours), F.lit("time_span_too_short")).otherwise(F.lit("ok")))
    return row.withColumn("reason", reason).withColumn("retrain", F.col("reason") == "ok")


def retrain_job(
    kpi: DataFrame, as_of: datetime, path: str, days: int = 30, cooling_ratio: float = S.COOLING_RATIO,
    models: dict[str, Callable] | None = None, **limits,
) -> DataFrame:
    """Guard, features, training and saving; returns the decision row with the chosen model."""
    guard = retrain_guard(kpi, as_of, days, **limits)
    verdict = guard.first()
    if not verdict["retrain"]:
        return guard.withColumn("model", F.lit(None).cast("string"))
    recent = kpi.filter((F.col("timestamp") >= F.lit(as_of - timedelta(days=days))) & (F.col("timestamp") <= F.lit(as_of)))
    ready = recent.withColumn("cooling_power_w", F.col("asic_power_w") * lit_d(cooling_ratio))
    features = materialize(feature_set(ready), "features")
    result = train_and_compare(features, models)
    save_model(result, features, path, as_of)
    return guard.withColumn("model", F.lit(result["best"]))
