"""Weighted gradient-boosted classifier: training, validation, sweeps, importance, scoring."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from typing import TypeVar

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from renewlens import schema as s
from renewlens.functions.scalars import quoted
from renewlens.operators.evaluation import _with_pr, _rank_metrics, thresholds
from renewlens.operators.keysets import stratified_folds
from renewlens.session import ensure_checkpointing, stage

WEIGHT = "_weight"
FEATURES = "_features"
SCORE = "churn_probability"
#: Fits that run at the same time.
AT_ONCE = 8
T = TypeVar("T")


def class_weight(df: DataFrame, pos_weight: float, label: str = "churn_label") -> DataFrame:
    """Row weight: ``pos_weight`` for positives, 1 for negatives."""
    return df.withColumn(
        WEIGHT, F.when(F.col(label) == 1, float(pos_weight)).otherwise(1.0)
    )


def assembler(columns: Sequence[str]) -> VectorAssembler:
    """Feature vector; a null is an error because the feature table has none."""
    return VectorAssembler(inputCols=list(columns), outputCol=FEATURES, handleInvalid="error")


def classifier(params: Mapping, label: str = "churn_label") -> GBTClassifier:
    """Booster for the published parameter names.

    The engine has no L1/L2 penalty, and samples columns per node instead of per tree. ``gamma`` is a
    loss reduction in the published settings and a variance reduction here, so it only applies when
    ``gamma_as_gain`` asks for it.
    """
    return GBTClassifier(
        featuresCol=FEATURES,
        labelCol=label,
        weightCol=WEIGHT,
        maxIter=int(params["n_estimators"]),
        maxDepth=int(params["max_depth"]),
        stepSize=float(params["learning_rate"]),
        subsamplingRate=float(params["subsample"]),
        featureSubsetStrategy=str(params["colsample"]),
        minInstancesPerNode=int(params["min_child"]),
        minInfoGain=float(params["gamma"]) if params.get("gamma_as_gain") else 0.0,
        seed=int(params["seed"]),
        checkpointInterval=10,
    )


def train_gbt(
    df: DataFrame,
    columns: Sequence[str],
    params: Mapping | None = None,
    label: str = "churn_label",
) -> PipelineModel:
    """Fit on the labelled rows. Long boosting runs cut their lineage every ten trees."""
    params = {**s.DEFAULT_PARAMS, **(params or {})}
    ensure_checkpointing(df.sparkSession)
    rows = class_weight(df.where(F.col(label).isNotNull()), params["pos_weight"], label)
    return Pipeline(stages=[assembler(columns), classifier(params, label)]).fit(rows)


def booster(model: PipelineModel) -> GBTClassificationModel:
    return model.stages[-1]


def feature_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def save_model(model: PipelineModel, path: str) -> None:
    """The parameters travel in the stage metadata."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_params(spark: SparkSession, params: Mapping, path: str) -> None:
    """Scalar parameters as one JSON line."""
    scalar = {k: v for k, v in params.items() if isinstance(v, (int, float, str, bool))}
    spark.createDataFrame([(json.dumps(scalar),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def load_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def score(df: DataFrame, model: PipelineModel, name: str = SCORE) -> DataFrame:
    """Adds the churn probability; a row-local transform."""
    p = F.element_at(vector_to_array("probability"), 2)
    return model.transform(df).withColumn(name, p).drop(
        FEATURES, "rawPrediction", "probability", "prediction"
    )


def feature_importance(
    spark: SparkSession, model: PipelineModel, k: int | None = None
) -> DataFrame:
    """Normalised impurity gain per feature, highest first."""
    values = booster(model).featureImportances.toArray().tolist()
    rows = list(zip(feature_names(model), values))
    out = spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
    return out if k is None else out.limit(k)


# --- validation ----------------------------------------------------------------


def run_together(spark: SparkSession, jobs: Sequence[Callable[[], T]], at_once: int = AT_ONCE) -> list[T]:
    """Results of functions that start Spark jobs, ``at_once`` of them at a time, in their order.

    A fit is a chain of short jobs that leave most of a cluster idle, so several fits fill the gaps. The
    threads inherit the caller's job group and pool. The first error is raised when the rest has ended.
    """
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [f.result() for f in started]


def first_trees(model: PipelineModel, n: int) -> PipelineModel:
    """The model after its first ``n`` boosting steps.

    Every step is seeded by its number and sees the steps before only, so this is the model that a
    fit of ``n`` steps gives.
    """
    whole = booster(model)
    if not 1 <= n <= len(whole.treeWeights):
        raise ValueError(f"the model has {len(whole.treeWeights)} trees, not {n}")
    context = SparkContext._active_spark_context
    kind = context._jvm.org.apache.spark.ml.classification.GBTClassificationModel
    java_trees = whole._java_obj.trees()
    trees = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = context._gateway.new_array(context._jvm.double, n)
    for i in range(n):
        trees[i] = java_trees[i]
        weights[i] = whole.treeWeights[i]
    part = GBTClassificationModel(kind(f"{whole.uid}_{n}", trees, weights))
    return PipelineModel([model.stages[0], part.setFeaturesCol(FEATURES)])


def fold_metrics(
    scored: DataFrame, label: str = "churn_label", fold: str | Sequence[str] = "fold"
) -> DataFrame:
    """Average precision, ROC area and best F1 of every fold (or combination of columns), in one job."""
    folds = [fold] if isinstance(fold, str) else list(fold)
    points = _with_pr(thresholds(scored, SCORE, label, folds))
    best = F.min(F.struct((-F.col("f1")).alias("neg_f1"), "threshold", "tp", "fp")).alias("b")
    per_fold = points.groupBy(*folds).agg(
        *[c.alias(k) for k, c in _rank_metrics().items()],
        best,
        F.max("positives").alias("positives"),
    )
    f1 = 2 * F.col("b.tp") / (F.col("b.tp") + F.col("b.fp") + F.col("positives"))
    return per_fold.select(*folds, "average_precision", "roc_auc", f1.alias("f1"))


def summarise_folds(per_fold: DataFrame | GroupedData) -> DataFrame:
    """Mean and population deviation over the folds, of all rows or of each group."""
    return per_fold.agg(
        F.avg("average_precision").alias("pr_auc_mean"),
        F.stddev_pop("average_precision").alias("pr_auc_std"),
        F.avg("roc_auc").alias("roc_auc_mean"),
        F.stddev_pop("roc_auc").alias("roc_auc_std"),
        F.avg("f1").alias("f1_mean"),
        F.stddev_pop("f1").alias("f1_std"),
    )


def with_folds(
    df: DataFrame, k: int, label: str = "churn_label", key: str | Sequence[str] = "Co_Ref"
) -> DataFrame:
    """Labelled rows with their fold, staged so that all fits of a search read the same table."""
    labelled = df.where(F.col(label).isNotNull())
    return stage(stratified_folds(stage(labelled), label, k, key))


def cross_validate_trials(
    folded: DataFrame,
    columns: Sequence[str],
    trials: Sequence[Mapping],
    k: int = 5,
    label: str = "churn_label",
    at_once: int = AT_ONCE,
) -> DataFrame:
    """(trial, fold, metrics) of several settings on a table from :func:`with_folds`.

    All fits of all folds run together from the one staged table. Settings that differ in the number
    of trees alone share a fit of the longest run, which is scored at its prefixes. One evaluation
    job does all trials.
    """
    spark = folded.sparkSession
    settings = [{**s.DEFAULT_PARAMS, **t} for t in trials]
    shared: dict[str, list[int]] = {}
    for i, t in enumerate(settings):
        shared.setdefault(json.dumps({**t, "n_estimators": 0}, sort_keys=True), []).append(i)

    def fit(members: list[int], fold: int) -> list[DataFrame]:
        longest = max((settings[i] for i in members), key=lambda t: t["n_estimators"])
        model = train_gbt(folded.where(F.col("fold") != fold), columns, longest, label)
        held_out = folded.where(F.col("fold") == fold)
        return [
            score(held_out, first_trees(model, int(settings[i]["n_estimators"]))).select(
                F.lit(i).alias("trial"), "fold", label, SCORE
            )
            for i in members
        ]

    jobs = [partial(fit, members, fold) for members in shared.values() for fold in range(k)]
    parts = [part for found in run_together(spark, jobs, at_once) for part in found]
    # scored by group of parts, so that no plan has more than one part for each fit at once
    staged = run_together(
        spark, [partial(stage, reduce(DataFrame.unionByName, parts[i:i + k])) for i in range(0, len(parts), k)], at_once
    )
    return fold_metrics(reduce(DataFrame.unionByName, staged), label, ["trial", "fold"])


def cross_validate_folds(
    folded: DataFrame,
    columns: Sequence[str],
    params: Mapping | None = None,
    k: int = 5,
    label: str = "churn_label",
) -> DataFrame:
    """Per-fold metrics on a table from :func:`with_folds`: k fits at the same time, one evaluation job."""
    return cross_validate_trials(folded, columns, [params or {}], k, label).drop("trial")


def cross_validate(
    df: DataFrame,
    columns: Sequence[str],
    params: Mapping | None = None,
    k: int = 5,
    label: str = "churn_label",
    key: str | Sequence[str] = "Co_Ref",
) -> DataFrame:
    """Mean and deviation of the stratified k-fold metrics, one row."""
    folded = with_folds(df, k, label, key)
    return summarise_folds(cross_validate_folds(folded, columns, params, k, label))


def sweep(
    df: DataFrame,
    columns: Sequence[str],
    base: Mapping | None = None,
    grid: Sequence[tuple[str, Sequence]] | None = None,
    k: int = 3,
    label: str = "churn_label",
    key: str | Sequence[str] = "Co_Ref",
) -> tuple[dict, DataFrame]:
    """Greedy search, one parameter group after the other, by mean average precision.

    The trials of a group run together (:func:`cross_validate_trials`). A grid entry is (name, values); values that are mappings set several parameters together.
    Returns the best parameters and the table of all trials.
    """
    grid = grid or [
        ("pos_weight", s.SWEEP_WEIGHTS),
        ("max_depth", s.SWEEP_DEPTHS),
        ("rate", s.SWEEP_RATES),
    ]
    best = {**s.DEFAULT_PARAMS, **(base or {})}
    folded = with_folds(df, k, label, key)
    trials = []
    for name, values in grid:
        changes = [dict(v) if isinstance(v, Mapping) else {name: v} for v in values]
        per_fold = cross_validate_trials(folded, columns, [{**best, **c} for c in changes], k, label)
        rows = {r["trial"]: r for r in summarise_folds(per_fold.groupBy("trial")).collect()}
        for i, change in enumerate(changes):
            trials.append((name, json.dumps(change), *[float(x) for x in rows[i][1:]]))
        # max keeps the first of equals
        best.update(changes[max(range(len(changes)), key=lambda i: rows[i]["pr_auc_mean"])])
    table = df.sparkSession.createDataFrame(
        trials,
        "stage string, params string, pr_auc_mean double, pr_auc_std double, roc_auc_mean double, "
        "roc_auc_std double, f1_mean double, f1_std double",
    )
    return best, table


def important_features(importance: DataFrame, ratio: float = 0.01) -> DataFrame:
    """Features with at least ``ratio`` of the highest importance."""
    top = importance.agg(F.max("importance")).scalar()
    return importance.where(F.col("importance") >= top * ratio)


def select_features(
    df: DataFrame,
    columns: Sequence[str],
    params: Mapping | None = None,
    ratio: float = 0.01,
    tolerance: float = 0.002,
    k: int = 3,
    label: str = "churn_label",
    key: str | Sequence[str] = "Co_Ref",
) -> tuple[list[str], DataFrame]:
    """Drop weak features when the reduced set scores within ``tolerance`` of the full one."""
    folded = with_folds(df, k, label, key)
    # the model of all rows is fitted next to those of the folds
    model, full = run_together(df.sparkSession, [
        lambda: train_gbt(folded, columns, params, label),
        lambda: summarise_folds(cross_validate_folds(folded, columns, params, k, label)).first(),
    ])
    kept = [
        r["feature"]
        for r in important_features(feature_importance(df.sparkSession, model), ratio).collect()
    ]
    reduced = summarise_folds(cross_validate_folds(folded, kept, params, k, label)).first()
    use = reduced["pr_auc_mean"] >= full["pr_auc_mean"] - tolerance
    report = df.sparkSession.createDataFrame(
        [
            ("full", len(columns), full["pr_auc_mean"], not use),
            ("reduced", len(kept), reduced["pr_auc_mean"], bool(use)),
        ],
        "feature_set string, n_features int, pr_auc_mean double, chosen boolean",
    )
    return (kept if use else list(columns)), report


def highest_risk(
    scored: DataFrame, k: int = 3, label: str = "churn_label",
    key: Sequence[str] = ("Co_Ref", "Renewal_Year"),
) -> DataFrame:
    """The k rows with the highest probability, with their label; equals go by the full key."""
    keys = [c for c in key if c in scored.columns]
    return (
        scored.select(*keys, SCORE, label)
        .orderBy(F.desc(SCORE), *keys)
        .limit(k)
    )


def numeric_vector_ready(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Model inputs as doubles."""
    return df.withColumns({c: F.col(quoted(c)).cast("double") for c in columns})
