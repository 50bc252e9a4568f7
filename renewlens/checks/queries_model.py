"""Model training, validation, scoring and explanation. The learner has no SQL counterpart, so most of
these are checked by invariants in the tests; they run on the whole cohort."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens import schema as s
from renewlens.checks.registry import Tables, query
from renewlens.operators import cohort as c
from renewlens.operators import explain as x
from renewlens.operators import model as m
from renewlens.plans import deployment as d
from renewlens.plans.scoring import predictions, sorted_predictions
from renewlens.session import shared_dir, stage

# short training for checks; the published settings are schema.DEFAULT_PARAMS / TUNED_PARAMS
QUICK = {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3, "pos_weight": 5.0}
KEY = ["Co_Ref", "Renewal_Year"]


def _fitted(t: Tables):
    df = stage(t.features)
    names = c.model_feature_names(df)
    return df, names, m.train_gbt(df, names, QUICK)


@query("F08 M01 M02 M03 M09")
def train_and_score(t: Tables) -> DataFrame:
    df, _, model = _fitted(t)
    return m.score(df, model).select(*KEY, "churn_label", F.round(m.SCORE, 6).alias(m.SCORE))


@query(
    "M02",
    """select churn_label, count(*) as n, sum(case when churn_label = 1 then 9.5 else 1.0 end)
         as weight from cohort group by 1""",
    ["cohort"],
    ["weight"],
)
def class_weight(t: Tables) -> DataFrame:
    return m.class_weight(c.build_labels(t.bills), 9.5).groupBy("churn_label").agg(
        F.count("*").alias("n"), F.sum(m.WEIGHT).alias("weight")
    )


@query("S12")
def save_and_load_model(t: Tables) -> DataFrame:
    df, _, model = _fitted(t)
    path = f"{shared_dir(t.spark)}/model-{uuid.uuid4().hex}"
    m.save_model(model, path)
    m.save_params(t.spark, QUICK, f"{path}-params")
    again = m.load_model(path)
    params = m.load_params(t.spark, f"{path}-params")
    both = m.score(m.score(df, model, "before"), again, "after")
    return both.agg(
        F.count("*").alias("n"),
        F.max(F.abs(F.col("before") - F.col("after"))).alias("largest_difference"),
    ).withColumn("n_params", F.lit(len(params)))


@query("M05")
def cross_validate(t: Tables) -> DataFrame:
    df = stage(t.features)
    return m.cross_validate(df, c.model_feature_names(df), QUICK, k=5, key=KEY)


@query("M06")
def sweep(t: Tables) -> DataFrame:
    """All three published stages with their values and three folds; every run has 1 tree for 100."""
    df = stage(t.features)
    rates = [{**r, "n_estimators": r["n_estimators"] // 100} for r in s.SWEEP_RATES]
    grid = [("pos_weight", s.SWEEP_WEIGHTS), ("max_depth", s.SWEEP_DEPTHS), ("rate", rates)]
    return m.sweep(df, c.model_feature_names(df), {"n_estimators": 4}, grid, k=3, key=KEY)[1]


@query("M05 M06")
def boosting_lengths(t: Tables) -> DataFrame:
    """Metrics after every step of one run for each fold."""
    df = stage(t.features)
    names, steps = c.model_feature_names(df), list(range(1, 9))
    folded = m.with_folds(df, 5, key=KEY)
    trials = [{**QUICK, "n_estimators": n} for n in steps]
    found = m.summarise_folds(m.cross_validate_trials(folded, names, trials, 5).groupBy("trial"))
    return found.withColumn("n_estimators", F.element_at(F.array(*map(F.lit, steps)), F.col("trial") + 1)).drop("trial")


@query("M07")
def select_features(t: Tables) -> DataFrame:
    df = stage(t.features)
    return m.select_features(df, c.model_feature_names(df), {**QUICK, "n_estimators": 2}, k=2, key=KEY)[1]


@query("M08")
def feature_importance(t: Tables) -> DataFrame:
    _, _, model = _fitted(t)
    return m.feature_importance(t.spark, model, 25)


@query("M10 M13")
def contribution_points(t: Tables) -> DataFrame:
    df, names, model = _fitted(t)
    return x.contribution_points(x.explain(df, model, KEY), names, KEY)


@query("M12")
def global_importance(t: Tables) -> DataFrame:
    df, names, model = _fitted(t)
    return x.global_importance(x.explain(df, model, KEY), names, 20)


@query("M14 O04")
def highest_risk(t: Tables) -> DataFrame:
    df, _, model = _fitted(t)
    return m.highest_risk(m.score(df, model), 3)


@query("M15 M11 S10")
def score_cohort(t: Tables) -> DataFrame:
    df, _, model = _fitted(t)
    return sorted_predictions(predictions(df, model, 0.3))


@query("S12 M15 X10")
def score_unlabelled_cohort(t: Tables) -> DataFrame:
    """Trained on the years before the last, deployed with a manifest, read back for the last without labels."""
    df = stage(t.features)
    last = df.agg(F.max("Renewal_Year")).first()[0]
    past = df.where(F.col("Renewal_Year") < last)
    names, path = c.model_feature_names(df), f"{shared_dir(t.spark)}/deployed-{uuid.uuid4().hex}"
    d.deploy(m.train_gbt(past, names, QUICK), past, QUICK, 0.3, path)
    cohort = df.where(F.col("Renewal_Year") == last).drop("churn_label", "outcome_post_renewal")
    return sorted_predictions(d.score_deployed(cohort, path))


# --- parts without a learner, on arrays and scores made from table columns ----------------------

_PARTS = {
    "price": "coalesce(Total_Net_Paid, 0) / 1000 - 150",
    "tenure": "Tenure_Years - 2",
    "anchors": "coalesce(Current_Anchorings, 0) * -1.5",
}
_PARTS_SQL = " union all ".join(
    f"select Co_Ref, Renewal_Year, '{name}' as feature, ({e})::double as contribution from bills"
    for name, e in _PARTS.items()
)


def _explained(t: Tables) -> DataFrame:
    parts = F.array(*[F.expr(e).cast("double") for e in _PARTS.values()])
    return t.bills.select(*KEY, parts.alias(x.CONTRIBUTIONS))


@query(
    "M11",
    f"""select Co_Ref, Renewal_Year, string_agg(word, ' | ' order by pos) as top_reasons from (
          select Co_Ref, Renewal_Year,
            feature || case when contribution > 0 then ' (increases risk)' else ' (decreases risk)' end as word,
            row_number() over (partition by Co_Ref, Renewal_Year order by abs(contribution) desc, feature) as pos
          from ({_PARTS_SQL})) where pos <= 2 group by Co_Ref, Renewal_Year""",
    ["bills"],
)
def reasons_of_columns(t: Tables) -> DataFrame:
    return x.top_reasons(_explained(t), list(_PARTS), 2).select(*KEY, "top_reasons")


@query("M13", _PARTS_SQL, ["bills"], ["contribution"])
def contribution_points_of_columns(t: Tables) -> DataFrame:
    return x.contribution_points(_explained(t), list(_PARTS), KEY)


@query(
    "M12",
    f"select feature, avg(abs(contribution)) as mean_abs from ({_PARTS_SQL}) group by feature",
    ["bills"],
    ["mean_abs"],
)
def importance_of_columns(t: Tables) -> DataFrame:
    return x.global_importance(_explained(t), list(_PARTS))


@query(
    "M07",
    f"""with i as (select feature, avg(abs(contribution)) as importance from ({_PARTS_SQL}) group by feature)
        select feature, importance from i where importance >= 0.05 * (select max(importance) from i)""",
    ["bills"],
    ["importance"],
)
def important_columns(t: Tables) -> DataFrame:
    table = x.global_importance(_explained(t), list(_PARTS)).withColumnRenamed("mean_abs", "importance")
    return m.important_features(table, 0.05)


@query(
    "M14 O04",
    """select Co_Ref, Renewal_Year, score as churn_probability, label as churn_label from scored
       order by score desc, Co_Ref, Renewal_Year limit 5""",
    ["scored"],
    ["churn_probability"],
)
def highest_scores(t: Tables) -> DataFrame:
    scored = t.scored.withColumnsRenamed({"score": m.SCORE, "label": "churn_label"})
    return m.highest_risk(scored, 5)


@query(
    "S10",
    "select Co_Ref, Renewal_Year, round(score / 7, 4) as churn_probability from scored",
    ["scored"],
    ["churn_probability"],
)
def write_and_read_predictions(t: Tables) -> DataFrame:
    from renewlens.sources.tables import write_predictions

    path = f"{shared_dir(t.spark)}/io-{uuid.uuid4().hex}"
    write_predictions(t.scored.select(*KEY, (F.col("score") / 7).alias(m.SCORE)), path)
    return t.spark.read.option("header", True).csv(path).select(
        "Co_Ref", F.col("Renewal_Year").cast("int").alias("Renewal_Year"),
        F.col(m.SCORE).cast("double").alias(m.SCORE),
    )
