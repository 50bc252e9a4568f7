"""Score a cohort: probability, tier, flag, reasons and context columns per customer."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens import schema as s
from renewlens.operators.cohort import align_columns
from renewlens.operators.evaluation import churn_flag, risk_tier
from renewlens.operators.explain import CONTRIBUTIONS, explain, top_reasons
from renewlens.operators.model import SCORE, feature_names, score
from renewlens.session import stage
from renewlens.sources.tables import row_key


def predictions(
    df: DataFrame,
    model: PipelineModel,
    threshold: float,
    n_reasons: int = 3,
    keep: tuple[str, ...] = ("Co_Ref", "Renewal_Year"),
    approx_tiers: bool = False,
) -> DataFrame:
    """Prediction table of a cohort without labels, unsorted; the sink sorts.

    Contributions are computed next to the score in the same pass over the rows, so the reasons need
    no join back. The scored rows are staged once: tier cut-offs and result both read them.
    """
    names = feature_names(model)
    context = [c for c in s.PREDICTION_CONTEXT if c in df.columns]
    ready = align_columns(df, names)
    carried = list(dict.fromkeys([*[c for c in keep if c in df.columns], *context, SCORE]))
    scored = score(ready, model)
    reasons = top_reasons(explain(scored, model, carried), names, n_reasons).drop(
        CONTRIBUTIONS, "base_value"
    )
    staged = stage(reasons)
    tiered = risk_tier(staged, SCORE, approx_tiers).withColumn(
        "churn_flag", churn_flag(SCORE, threshold)
    )
    lead = [c for c in keep if c in df.columns]
    return tiered.select(*lead, SCORE, "risk_tier", "churn_flag", "top_reasons", *context)


def sorted_predictions(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc(SCORE), *row_key(scored))
