"""Learner invariants: contributions add up to the log-odds, folds, persistence, reports."""

from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from renewlens.operators import explain as x
from renewlens.operators import model as m
from renewlens.plans.scoring import predictions

NAMES = ["a", "b", "#_of_Connection", "noise"]
QUICK = {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.3, "pos_weight": 3.0, "min_child": 2,
         "subsample": 1.0, "colsample": "all"}


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 800
    pdf = pd.DataFrame({
        "Co_Ref": [f"c{i:04d}" for i in range(n)],
        "a": rng.integers(0, 6, n).astype(float),
        "b": rng.integers(0, 2, n),
        "#_of_Connection": np.round(rng.normal(size=n), 1),
        "noise": np.zeros(n),
    })
    logit = pdf.a - 3 + 2 * pdf.b * (pdf["#_of_Connection"] > 0)
    pdf["churn_label"] = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    return spark.createDataFrame(pdf).repartition(3).cache()


@pytest.fixture(scope="module")
def model(frame):
    return m.train_gbt(frame, NAMES, QUICK)


@pytest.fixture(scope="module")
def scored(frame, model):
    return m.score(frame, model).toPandas().set_index("Co_Ref")


def test_scores_are_probabilities_and_rank_well(scored):
    p = scored[m.SCORE]
    assert p.between(0, 1).all()
    pos, neg = p[scored.churn_label == 1], p[scored.churn_label == 0]
    assert (pos.to_numpy()[:, None] > neg.to_numpy()[None, :]).mean() > 0.75


def test_contributions_add_up_to_log_odds(frame, model, scored):
    got = x.explain(frame, model).toPandas().set_index("Co_Ref")
    total = got[x.CONTRIBUTIONS].map(sum) + got[x.BASE]
    p = scored.loc[got.index, m.SCORE]
    assert np.allclose(total, np.log(p / (1 - p)), atol=1e-6)
    # a constant column can never be split on
    assert got[x.CONTRIBUTIONS].map(lambda v: v[3]).abs().max() == 0.0


def tree_value(rows, node, known, row):
    r = rows[node]
    if r.left < 0:
        return r.prediction
    left, right = rows[int(r.left)], rows[int(r.right)]
    if r.feature in known:
        return tree_value(rows, int(r.left if row[r.feature] <= r.threshold else r.right), known, row)
    return (
        left.cover * tree_value(rows, int(r.left), known, row)
        + right.cover * tree_value(rows, int(r.right), known, row)
    ) / r.cover


def test_contributions_equal_brute_force_shapley(spark, frame, model, scored):
    nodes = x.tree_table(spark, model).toPandas()
    weights = m.booster(model).treeWeights
    trees = {t: {int(r.node): r for r in part.itertuples()} for t, part in nodes.groupby("tree")}
    got = x.explain(frame, model).toPandas().set_index("Co_Ref")
    for key in list(got.index[:5]):
        row = scored.loc[key, NAMES].to_numpy(dtype=float)
        want = np.zeros(len(NAMES))
        orders = list(permutations(range(len(NAMES))))
        for order in orders:
            known = set()
            before = sum(2 * w * tree_value(trees[t], 0, known, row) for t, w in enumerate(weights))
            for f in order:
                known = known | {f}
                after = sum(2 * w * tree_value(trees[t], 0, known, row) for t, w in enumerate(weights))
                want[f] += (after - before) / len(orders)
                before = after
        assert np.allclose(got.loc[key, x.CONTRIBUTIONS], want, atol=1e-9)


def test_long_paths_without_a_table_agree(spark, model, scored, monkeypatch):
    nodes = x.tree_table(spark, model).toPandas()
    weights = list(m.booster(model).treeWeights)
    values = scored[NAMES].to_numpy(dtype=float)
    tabled, base = x.leaf_tables(nodes, weights)
    monkeypatch.setattr(x, "MAX_TABLE_FEATURES", 1)
    direct, same_base = x.leaf_tables(nodes, weights)
    assert any(leaf[3] is None for leaf in direct) and base == same_base
    assert np.allclose(x.contributions_of(values, tabled), x.contributions_of(values, direct))


def test_blocks_of_leaves_add_up(spark, frame, model):
    """Many blocks with staged partial sums, one block, and the tables over patterns agree."""
    nodes = x.tree_table(spark, model).toPandas()
    tables, base = x.leaf_tables(nodes, list(m.booster(model).treeWeights))
    rows = frame.select("Co_Ref", *[f"`{c}`" for c in NAMES]).toPandas().set_index("Co_Ref")
    want = dict(zip(rows.index, x.contributions_of(rows[NAMES].to_numpy(dtype=float), tables)))
    for entries in (1, 60, x.BLOCK_ENTRIES):
        got = x.explain(frame, model, block_entries=entries).collect()
        assert len(got) == len(want) and got[0][x.BASE] == pytest.approx(base)
        assert all(np.allclose(r[x.CONTRIBUTIONS], want[r["Co_Ref"]], atol=1e-12) for r in got)
    assert x.explain(frame.limit(0), model).count() == 0


def test_a_model_of_600_trees_is_explained_in_blocks(spark, frame, model):
    """The trees of the small model a hundred times over: contributions still add up to the log-odds."""
    from pyspark import SparkContext
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassificationModel

    context, whole = SparkContext._active_spark_context, m.booster(model)
    trees = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, 600)
    weights = context._gateway.new_array(context._jvm.double, 600)
    java_trees = whole._java_obj.trees()
    for i in range(600):
        trees[i], weights[i] = java_trees[i % 6], whole.treeWeights[i % 6] / 100
    java = context._jvm.org.apache.spark.ml.classification.GBTClassificationModel("many", trees, weights)
    many = PipelineModel([model.stages[0], GBTClassificationModel(java).setFeaturesCol(m.FEATURES)])
    got = x.explain(frame, many, block_entries=4_000).toPandas().set_index("Co_Ref")
    p = m.score(frame, many).toPandas().set_index("Co_Ref").loc[got.index, m.SCORE]
    assert np.allclose(got[x.CONTRIBUTIONS].map(sum) + got[x.BASE], np.log(p / (1 - p)), atol=1e-6)
    small = m.score(frame, model).toPandas().set_index("Co_Ref").loc[got.index, m.SCORE]
    assert np.allclose(p, small, atol=1e-9)


def test_long_paths_by_orderings():
    """Paths of up to 16 features, shares of zero among them, against the sums over orderings."""
    rng = np.random.default_rng(5)
    for length in (1, 2, 3, 8, 16):
        zero = rng.random(length).round(2)
        zero[0] = 0.0
        leaf = {"tree": 0, "features": list(range(length)), "low": [0.5] * length, "high": [np.inf] * length,
                "zero": list(zero), "prediction": 1.5}
        values = rng.integers(0, 2, (40, length)).astype(float)
        out = np.zeros((length, 40))
        x.Leaves([leaf], [0.5], 2.0).add_to(out, values)
        assert np.allclose(out.T, x.path_contributions(values, zero, 1.5), atol=1e-12)


def test_a_tree_that_is_one_leaf_and_a_feature_that_comes_again(spark):
    rows = [(0, 0, -1, -1, -1, None, 3.0, 10.0)]
    rows += [(1, 0, 1, 4, 2, 5.0, 0.0, 10.0), (1, 1, 2, 3, 2, 1.0, 0.0, 8.0), (1, 2, -1, -1, -1, None, 1.0, 2.0),
             (1, 3, -1, -1, -1, None, 2.0, 6.0), (1, 4, -1, -1, -1, None, 4.0, 2.0)]
    nodes = spark.createDataFrame(
        rows, "tree int, node int, left int, right int, feature int, threshold double, prediction double, cover double"
    )
    got = {(r["tree"], r["leaf"]): r for r in x.leaf_paths(nodes).collect()}
    assert got[0, 0]["features"] == [] and got[0, 0]["prediction"] == 3.0
    middle = got[1, 3]
    assert (middle["features"], middle["low"], middle["high"]) == ([2], [1.0], [5.0])
    assert middle["zero"] == pytest.approx([0.6])
    assert [len(b) for b in x.leaf_blocks(x.leaf_paths(nodes), 2)] == [1, 3]


def test_top_reasons(spark):
    df = spark.createDataFrame([([0.1, -0.5, 0.5, 0.0],)], f"{x.CONTRIBUTIONS} array<double>")
    text = x.top_reasons(df, ["w", "z", "y", "v"], 3).first()["top_reasons"]
    assert text == "y (increases risk) | z (decreases risk) | w (increases risk)"


def test_points_and_global_importance(frame, model):
    explained = x.explain(frame, model)
    points = x.contribution_points(explained, NAMES)
    assert points.count() == frame.count() * len(NAMES)
    a = {r["feature"]: r["mean_abs"] for r in x.global_importance(explained, NAMES).collect()}
    b = {
        r["feature"]: r["v"]
        for r in points.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("v")).collect()
    }
    assert a == pytest.approx(b)


def test_save_and_load(spark, frame, model, scored, tmp_path):
    m.save_model(model, str(tmp_path / "model"))
    again = m.score(frame, m.load_model(str(tmp_path / "model"))).toPandas().set_index("Co_Ref")
    assert np.allclose(again.loc[scored.index, m.SCORE], scored[m.SCORE])
    m.save_params(spark, {**QUICK, "grid": [1]}, str(tmp_path / "params"))
    assert m.load_params(spark, str(tmp_path / "params")) == QUICK


def test_importance_names_and_selection(spark, model):
    imp = m.feature_importance(spark, model)
    rows = {r["feature"]: r["importance"] for r in imp.collect()}
    assert set(rows) == set(NAMES) and sum(rows.values()) == pytest.approx(1.0)
    kept = {r["feature"] for r in m.important_features(imp).collect()}
    assert "noise" not in kept and "a" in kept


def test_cross_validation_and_sweep(frame):
    quick = {**QUICK, "n_estimators": 2}
    row = m.cross_validate(frame, NAMES, quick, k=3).first()
    assert 0 < row["pr_auc_mean"] <= 1 and row["pr_auc_std"] >= 0 and 0 < row["f1_mean"] <= 1
    best, trials = m.sweep(frame, NAMES, quick, [("max_depth", [1, 2])], k=2)
    rows = trials.collect()
    assert len(rows) == 2
    top = max(rows, key=lambda r: r["pr_auc_mean"])
    assert f'"max_depth": {best["max_depth"]}' in top["params"]


def test_prefix_of_a_long_run_is_the_short_run(frame):
    long = m.train_gbt(frame, NAMES, {**QUICK, "subsample": 0.7})
    for n in (1, 4):
        short = m.train_gbt(frame, NAMES, {**QUICK, "subsample": 0.7, "n_estimators": n})
        both = m.score(m.score(frame, m.first_trees(long, n), "prefix"), short, "own")
        assert both.agg(F.max(F.abs(F.col("prefix") - F.col("own")))).first()[0] < 1e-12
    with pytest.raises(ValueError):
        m.first_trees(long, 7)


def test_trials_equal_a_plain_loop_of_fits(frame):
    """Fits at the same time, shared prefixes and one evaluation job against one fit after the other."""
    trials = [{**QUICK, "n_estimators": 3}, {**QUICK, "n_estimators": 1}, {**QUICK, "max_depth": 2, "n_estimators": 2}]
    folded = m.with_folds(frame, 3)
    got = {(r["trial"], r["fold"]): r for r in m.cross_validate_trials(folded, NAMES, trials, 3).collect()}
    assert len(got) == 9
    for i, params in enumerate(trials):
        for fold in range(3):
            model = m.train_gbt(folded.where(F.col("fold") != fold), NAMES, params)
            want = m.fold_metrics(m.score(folded.where(F.col("fold") == fold), model)).first()
            for name in ("average_precision", "roc_auc", "f1"):
                assert got[i, fold][name] == pytest.approx(want[name], abs=1e-9)


def test_jobs_run_together_and_raise(spark):
    assert m.run_together(spark, [lambda i=i: spark.range(i).count() for i in range(5)], 3) == [0, 1, 2, 3, 4]
    with pytest.raises(ZeroDivisionError):
        m.run_together(spark, [lambda: 1, lambda: 1 / 0])


def test_predictions_table(frame, model):
    out = predictions(frame.drop("churn_label", "noise").withColumn("Band", F.lit("Band A")), model, 0.5)
    assert out.columns == [
        "Co_Ref", "churn_probability", "risk_tier", "churn_flag", "top_reasons", "Band",
    ]
    pdf = out.toPandas()
    assert len(pdf) == frame.count()
    assert (pdf.churn_flag == (pdf.churn_probability >= 0.5)).all()
    assert pdf.top_reasons.str.count(r"\|").eq(2).all()
    assert set(pdf.risk_tier) <= {"Critical", "High", "Medium", "Low"}


def test_highest_risk_breaks_ties_by_key(spark):
    df = spark.createDataFrame(
        [("b", 0.9, 1), ("a", 0.9, 0), ("c", 0.1, 0)], "Co_Ref string, churn_probability double, churn_label int"
    )
    assert [r["Co_Ref"] for r in m.highest_risk(df, 2).collect()] == ["a", "b"]
