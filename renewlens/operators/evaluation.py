"""Threshold curves, scalar metrics, tiers and calibration, all from the score ladder.

Every function accepts ``by`` columns (for example a fold), so several evaluations share one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.functions.buckets import equal_width_bin
from renewlens.functions.scalars import flag
from renewlens.operators.ladder import class_ladder, quantiles
from renewlens.operators.profiling import in_equal_bins

EPSILON = 1e-9
FALLBACK_THRESHOLD = 0.3
TIERS = ["Critical", "High", "Medium", "Low"]


def f1_of(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / (precision + recall + EPSILON)


def thresholds(
    df: DataFrame, score: str, label: str, by: Sequence[str] = ()
) -> DataFrame:
    """True and false positives when flagging score >= threshold, per distinct score."""
    ladder = class_ladder(df, score, label, by)
    return ladder.select(
        *by,
        F.col("value").alias("threshold"),
        (F.col("tot_1") - F.col("cum_1") + F.col("n_1")).alias("tp"),
        (F.col("tot_0") - F.col("cum_0") + F.col("n_0")).alias("fp"),
        F.col("n_0"),
        F.col("n_1"),
        F.col("cum_1"),
        F.col("tot_0").alias("negatives"),
        F.col("tot_1").alias("positives"),
    )


def _with_pr(points: DataFrame) -> DataFrame:
    tp = F.col("tp").cast("double")
    precision = tp / (F.col("tp") + F.col("fp"))
    recall = F.try_divide(tp, F.col("positives"))
    return points.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", f1_of(F.col("precision"), F.col("recall"))
    )


def pr_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each distinct threshold, closed by the point (1, 0)."""
    points = _with_pr(thresholds(df, score, label, by)).select(
        *by, "threshold", "precision", "recall"
    )
    end = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    end = end.select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def roc_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate at each distinct threshold, from the origin (0, 0) on.

    The origin lies above every score and has no threshold.
    """
    points = thresholds(df, score, label, by).select(
        *by,
        "threshold",
        F.try_divide(F.col("fp").cast("double"), F.col("negatives")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("positives")).alias("tpr"),
    )
    start = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    return points.unionByName(start.select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    ))


def _rank_metrics() -> dict[str, Column]:
    n0, n1 = F.col("n_0").cast("double"), F.col("n_1").cast("double")
    below = F.col("cum_1") - n1
    # pairs in which the positive scores higher, ties as half
    u1 = F.max("negatives").cast("double") * F.max("positives") - F.sum(n0 * (below + n1 / 2.0))
    ap = F.sum(n1 / F.col("positives") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return {
        "average_precision": ap,
        "roc_auc": F.try_divide(u1, F.max("negatives").cast("double") * F.max("positives")),
    }


def ranking_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision (step form) and area under the ROC curve."""
    points = thresholds(df, score, label, by).where(F.col("positives") > 0)
    return points.groupBy(*by).agg(*[c.alias(k) for k, c in _rank_metrics().items()])


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    return ranking_metrics(df, score, label).select("average_precision")


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    return ranking_metrics(df, score, label).select("roc_auc")


def _best(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Row with the highest F1; the lowest threshold wins among equals."""
    best = F.min(F.struct((-F.col("f1")).alias("neg_f1"), "threshold", "precision", "recall"))
    return points.groupBy(*by).agg(best.alias("b")).select(
        *by, "b.threshold", "b.precision", "b.recall", (-F.col("b.neg_f1")).alias("f1")
    )


def best_f1_threshold(
    df: DataFrame, score: str, label: str, by: Sequence[str] = ()
) -> DataFrame:
    return _best(_with_pr(thresholds(df, score, label, by)), by)


def constrained_threshold(
    df: DataFrame,
    score: str,
    label: str,
    min_precision: float = 0.25,
    min_recall: float = 0.50,
    fallback: float = FALLBACK_THRESHOLD,
) -> DataFrame:
    """Threshold of the best F1 that keeps both minimums; the fallback when none does."""
    points = _with_pr(thresholds(df, score, label))
    ok = (F.col("precision") >= min_precision) & (F.col("recall") >= min_recall) & (F.col("f1") > 0)
    best = _best(points.where(ok), [])
    return best.select(F.coalesce("threshold", F.lit(fallback)).alias("threshold"))


def confusion_counts(
    df: DataFrame, score: str, label: str, threshold: Column | float, by: Sequence[str] = ()
) -> DataFrame:
    """tp, fp, tn, fn and the business names for them; ``threshold`` may be a scalar subquery."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    rows = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)).withColumn(
        "_p", flag(F.col(score) >= threshold)
    )
    p, y = F.col("_p"), F.col(label)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if((p == 1) & (y == 1)).alias("tp"),
        F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 0)).alias("tn"),
        F.count_if((p == 0) & (y == 1)).alias("fn"),
    ).withColumns({
        "flagged": F.col("tp") + F.col("fp"),
        "actual": F.col("tp") + F.col("fn"),
        "caught": F.col("tp"),
        "missed": F.col("fn"),
    })


def _zero_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def classification_metrics(
    df: DataFrame, score: str, label: str, threshold: Column | float, by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall and F1 of the positive class at a threshold; 0 where undefined."""
    c = confusion_counts(df, score, label, threshold, by)
    return c.withColumns({
        "precision": _zero_div(F.col("tp"), F.col("flagged")),
        "recall": _zero_div(F.col("tp"), F.col("actual")),
        "f1": _zero_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    })


def classification_report(
    df: DataFrame,
    score: str,
    label: str,
    threshold: Column | float,
    names: Sequence[str] = ("Retained", "Churned"),
) -> DataFrame:
    """Per class, macro and weighted precision, recall, F1 and support."""
    c = confusion_counts(df, score, label, threshold)
    tp, fp, tn, fn_ = (F.col(k) for k in ("tp", "fp", "tn", "fn"))

    def entry(name: str, hit: Column, wrong: Column, miss: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            _zero_div(hit, hit + wrong).alias("precision"),
            _zero_div(hit, hit + miss).alias("recall"),
            _zero_div(2 * hit, 2 * hit + wrong + miss).alias("f1"),
            (hit + miss).alias("support"),
        )

    both = c.select(
        entry(names[0], tn, fn_, fp).alias("neg"), entry(names[1], tp, fp, fn_).alias("pos"),
        ((tp + tn).cast("double") / F.col("n")).alias("accuracy"),
    )

    def average(name: str, w0: Column, w1: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            *[
                ((F.col(f"neg.{m}") * w0 + F.col(f"pos.{m}") * w1) / (w0 + w1)).alias(m)
                for m in ("precision", "recall", "f1")
            ],
            (F.col("neg.support") + F.col("pos.support")).alias("support"),
        )

    one = F.lit(1.0)
    weights = F.col("neg.support").cast("double"), F.col("pos.support").cast("double")
    return both.select(
        F.inline(F.array(
            F.col("neg"),
            F.col("pos"),
            average("macro avg", one, one),
            average("weighted avg", *weights),
        ))
    )


def threshold_table(
    df: DataFrame,
    score: str,
    label: str,
    grid: Sequence[float] = tuple(0.05 + 0.05 * i for i in range(10)),
) -> DataFrame:
    """Precision, recall, F1, flagged and caught at each grid threshold, one pass over the scores.

    Scores are compared with the grid as computed; the shown threshold is rounded to two digits.
    """
    p, y = F.col(score), F.col(label)
    row = df.where(p.isNotNull() & y.isin(0, 1)).agg(
        F.count_if(y == 1).alias("actual"),
        *[F.count_if(p >= t).alias(f"flagged_{i}") for i, t in enumerate(grid)],
        *[F.count_if((p >= t) & (y == 1)).alias(f"caught_{i}") for i, t in enumerate(grid)],
    )
    entries = F.array(*[
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col(f"flagged_{i}").alias("flagged"),
            F.col(f"caught_{i}").alias("caught"),
        )
        for i, t in enumerate(grid)
    ])
    points = row.select("actual", F.inline(entries))
    precision = _zero_div(F.col("caught"), F.col("flagged"))
    recall = _zero_div(F.col("caught"), F.col("actual"))
    f1 = _zero_div(2 * F.col("caught"), F.col("flagged") + F.col("actual"))
    return points.select(
        F.round("threshold", 2).alias("threshold"),
        F.round(precision, 3).alias("precision"),
        F.round(recall, 3).alias("recall"),
        F.round(f1, 3).alias("f1"),
        "flagged",
        "caught",
    )


def risk_tier(df: DataFrame, score: str = "churn_probability", approx: bool = False) -> DataFrame:
    """Critical from the 90th percentile, High from the 70th, Medium from the 40th, else Low.

    A missing score has no tier.
    """
    cuts = quantiles(df, score, {"p90": 0.9, "p70": 0.7, "p40": 0.4}, approx=approx)
    cut = cuts.select(F.struct("p90", "p70", "p40")).scalar()
    p = F.col(score)
    return df.withColumn("_cut", cut).withColumn(
        "risk_tier",
        F.when(p >= F.col("_cut.p90"), "Critical")
        .when(p >= F.col("_cut.p70"), "High")
        .when(p >= F.col("_cut.p40"), "Medium")
        .when(p.isNotNull(), "Low"),
    ).drop("_cut")


def churn_flag(score: str, threshold: Column | float) -> Column:
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return flag(F.col(score) >= threshold)


def calibration_table(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score and actual rate in each bin [lo, hi) of 0..1 that has rows; 1.0 is in no bin."""
    p = F.col(score)
    step = F.lit(1.0 / bins)
    return (
        df.where((p >= 0) & (p < 1) & F.col(label).isNotNull())
        .groupBy(equal_width_bin(p, F.lit(0.0), step, bins).alias("bin"))
        .agg(
            F.avg(p).alias("mean_score"),
            F.avg(F.col(label).cast("double")).alias("actual_rate"),
            F.count("*").alias("n"),
        )
    )


def score_histogram_by_label(
    df: DataFrame, score: str, label: str, bins: int = 50
) -> DataFrame:
    """Equal-width counts and densities of each class (0 and 1) over the class's own score range."""
    p, y = F.col(score).cast("double"), F.col(label)
    rows = df.where(p.isNotNull() & y.isin(0, 1))
    ends = rows.agg(F.array(*[
        F.struct(
            F.min(F.when(y == c, p)).alias("lo"),
            F.max(F.when(y == c, p)).alias("hi"),
            F.count_if(y == c).alias("n"),
        )
        for c in (0, 1)
    ])).scalar()
    own = rows.withColumn("_both", ends).withColumn(
        "_ends", F.element_at("_both", y.cast("int") + 1)
    )
    return in_equal_bins(own, p, bins).groupBy(label, "bin").agg(
        F.min(F.col("_lo") + F.col("bin") * F.col("_step")).alias("lo"),
        F.count("*").alias("n"),
        (F.count("*") / F.max("_ends.n") / F.max("_step")).alias("density"),
    )


def tier_distribution(df: DataFrame) -> DataFrame:
    """Rows and flagged rows per tier."""
    return df.groupBy("risk_tier").agg(
        F.count("*").alias("n"), F.sum("churn_flag").alias("flagged")
    )


def evaluate(
    df: DataFrame, score: str, label: str, threshold: float | None = None
) -> DataFrame:
    """One metric record: threshold, ranking metrics, metrics and counts at that threshold.

    Counts at a threshold are read off the ladder: they belong to the lowest score at or above it.
    Without a threshold the one with the best F1 is taken.
    """
    points = _with_pr(thresholds(df, score, label))
    order = -F.col("f1") if threshold is None else F.col("threshold")
    eligible = F.lit(True) if threshold is None else F.col("threshold") >= float(threshold)
    pick = F.struct(order.alias("rank"), "threshold", "tp", "fp")
    one = points.agg(
        *[c.alias(k) for k, c in _rank_metrics().items()],
        F.min(F.when(eligible, pick)).alias("b"),
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
    )
    tp, fp = F.coalesce("b.tp", F.lit(0)), F.coalesce("b.fp", F.lit(0))
    used = F.col("b.threshold") if threshold is None else F.lit(float(threshold))
    return one.select(
        used.alias("threshold"),
        F.col("average_precision").alias("pr_auc"),
        "roc_auc",
        _zero_div(tp, tp + fp).alias("precision"),
        _zero_div(tp, F.col("positives")).alias("recall"),
        _zero_div(2 * tp, tp + fp + F.col("positives")).alias("f1"),
        (tp + fp).alias("n_flagged"),
        F.col("positives").alias("n_actual_churn"),
        (F.col("positives") + F.col("negatives")).alias("n_test"),
        tp.alias("caught_churners"),
        (F.col("positives") - tp).alias("missed_churners"),
    )
