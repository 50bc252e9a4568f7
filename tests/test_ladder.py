"""Ladder, quantiles, curves and rank tests against brute force on small data with heavy ties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from renewlens.operators import evaluation as e
from renewlens.operators import stattests as st
from renewlens.operators.ladder import class_ladder, cut_points, quantiles
from renewlens.operators.keysets import stratified_folds


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(7)
    n = 3000
    score = np.round(rng.beta(2, 5, n), 2)
    # one value holds a third of all rows
    score[rng.random(n) < 0.33] = 0.25
    label = (rng.random(n) < 0.1 + 0.5 * score).astype(int)
    group = np.where(rng.random(n) < 0.7, "big", "small")
    return pd.DataFrame({"id": range(n), "score": score, "label": label, "g": group})


@pytest.fixture(scope="module")
def frame(spark, sample):
    return spark.createDataFrame(sample).repartition(5)


def test_ladder_counts(frame, sample):
    got = class_ladder(frame, "score", "label").toPandas().sort_values("value")
    for row in got.itertuples():
        at, below = sample.score == row.value, sample.score <= row.value
        assert (row.n_0, row.n_1) == ((at & (sample.label == 0)).sum(), (at & (sample.label == 1)).sum())
        assert row.cum_1 == (below & (sample.label == 1)).sum()
        assert row.cum_0 == (below & (sample.label == 0)).sum()
    assert (got.tot_1 == sample.label.sum()).all()
    assert len(got) == sample.score.nunique()


def test_ladder_by_group(frame, sample):
    got = class_ladder(frame, "score", "label", ["g"]).toPandas()
    for row in got.itertuples():
        part = sample[(sample.g == row.g) & (sample.score <= row.value)]
        assert row.cum_1 == part.label.sum()


def test_ladder_does_not_depend_on_buckets(frame):
    many = class_ladder(frame, "score", "label", buckets=13).orderBy("value").collect()
    one = class_ladder(frame, "score", "label", buckets=1).orderBy("value").collect()
    assert many == one


def test_only_bucket_totals_meet_in_one_task(frame):
    plan = class_ladder(frame, "score", "label")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert single
    for i in single:
        assert "HashAggregate(keys=[_bucket" in lines[i + 1]


def test_cut_points_are_bounded(frame):
    cuts = cut_points(frame, F.col("score"), 8)
    assert len(cuts) <= 7 and cuts == sorted(set(cuts))


def test_quantiles_interpolate(frame, sample):
    probs = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.977, "f": 1.0}
    row = quantiles(frame, "score", probs).first()
    for name, q in probs.items():
        assert row[name] == pytest.approx(np.quantile(sample.score, q), abs=1e-12)
    for row in quantiles(frame, "score", probs, ["g"]).collect():
        part = sample[sample.g == row["g"]].score
        assert row["n"] == len(part)
        assert row["e"] == pytest.approx(np.quantile(part, 0.977), abs=1e-12)


def test_quantiles_of_one_value(spark):
    df = spark.createDataFrame([(2.5,)] * 4, "v double")
    assert quantiles(df, "v", {"m": 0.5}).first()["m"] == 2.5


def brute_curve(sample):
    rows = []
    pos = sample.label.sum()
    for t in sorted(sample.score.unique()):
        hit = sample.score >= t
        tp = (hit & (sample.label == 1)).sum()
        rows.append((t, tp / hit.sum(), tp / pos))
    return rows


def test_pr_curve_and_average_precision(frame, sample):
    want = brute_curve(sample)
    got = e.pr_curve(frame, "score", "label").toPandas().dropna().sort_values("threshold")
    assert np.allclose(got[["threshold", "precision", "recall"]].to_numpy(), np.array(want))
    ap, last = 0.0, 0.0
    for _, p, r in reversed(want):
        ap += (r - last) * p
        last = r
    assert e.average_precision(frame, "score", "label").first()[0] == pytest.approx(ap)


def test_auc_is_the_share_of_ordered_pairs(frame, sample):
    a = sample[sample.label == 0].score.to_numpy()[:, None]
    b = sample[sample.label == 1].score.to_numpy()[None, :]
    auc = ((b > a).sum() + 0.5 * (b == a).sum()) / a.size / b.size
    assert e.roc_auc(frame, "score", "label").first()[0] == pytest.approx(auc)


def test_best_threshold_is_lowest_of_equals(spark):
    # 0.4 and 0.5 flag the same true positives only when ties are read upwards
    df = spark.createDataFrame(
        [(0.1, 0), (0.4, 1), (0.5, 1), (0.9, 0)], "score double, label int"
    )
    best = e.best_f1_threshold(df, "score", "label").first()
    assert best["threshold"] == 0.4
    assert best["f1"] == pytest.approx(2 * (2 / 3) / (2 / 3 + 1 + 1e-9))


def test_constrained_threshold_falls_back(frame):
    assert e.constrained_threshold(frame, "score", "label", 0.999, 0.999).first()[0] == 0.3


def test_evaluate_at_given_threshold(frame, sample):
    row = e.evaluate(frame, "score", "label", 0.305).first()
    hit = sample.score >= 0.305
    assert row["n_flagged"] == hit.sum()
    assert row["caught_churners"] == (hit & (sample.label == 1)).sum()
    assert row["n_test"] == len(sample)
    nothing = e.evaluate(frame, "score", "label", 2.0).first()
    assert nothing["n_flagged"] == 0 and nothing["precision"] == 0.0


def test_tiers_cover_every_row(frame, sample):
    counts = {r["risk_tier"]: r["count"] for r in e.risk_tier(frame, "score").groupBy("risk_tier").count().collect()}
    assert sum(counts.values()) == len(sample)
    p90 = np.percentile(sample.score, 90)
    assert counts["Critical"] == (sample.score >= p90).sum()


def test_calibration_leaves_out_one(spark):
    df = spark.createDataFrame([(1.0, 1), (0.95, 1), (0.05, 0)], "p double, y int")
    bins = {r["bin"]: r["n"] for r in e.calibration_table(df, "p", "y").collect()}
    assert bins == {9: 1, 0: 1}


def test_mann_whitney_against_brute_force(frame, sample):
    row = st.mann_whitney_tests(frame, ["score"], "label").first()
    a = sample[sample.label == 0].score.to_numpy()[:, None]
    b = sample[sample.label == 1].score.to_numpy()[None, :]
    u = (a > b).sum() + 0.5 * (a == b).sum()
    n0, n1 = a.size, b.size
    assert row["u_statistic"] == pytest.approx(u)
    assert (row["n_0"], row["n_1"]) == (n0, n1)
    n = n0 + n1
    z = (u - n0 * n1 / 2) / math.sqrt(n0 * n1 * (n + 1) / 12)
    assert row["effect_size_r"] == pytest.approx(abs(z) / math.sqrt(n))
    assert 0 <= row["p_value"] <= 1


def test_mann_whitney_sides_add_up(frame, sample):
    flipped = frame.withColumn("label", 1 - F.col("label"))
    a = st.mann_whitney_tests(frame, ["score"], "label").first()
    b = st.mann_whitney_tests(flipped, ["score"], "label").first()
    assert a["u_statistic"] + b["u_statistic"] == pytest.approx(a["n_0"] * a["n_1"])
    assert a["p_value"] == pytest.approx(b["p_value"])


def test_ks_against_brute_force(frame, sample):
    row = st.ks_by_label(frame, ["score"], "label").first()
    a = np.sort(sample[sample.label == 0].score.to_numpy())
    b = np.sort(sample[sample.label == 1].score.to_numpy())
    grid = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(a, grid, side="right") / len(a)
    fb = np.searchsorted(b, grid, side="right") / len(b)
    assert row["ks_stat"] == pytest.approx(np.abs(fa - fb).max())


def test_folds_are_balanced_within_labels(frame, sample):
    folded = stratified_folds(frame, "label", 5, "id")
    counts = folded.groupBy("label", "fold").count().toPandas()
    for _, part in counts.groupby("label"):
        assert len(part) == 5 and part["count"].max() - part["count"].min() <= 1
    assert folded.count() == len(sample)


def test_calibration_uses_the_computed_edges(spark):
    df = spark.createDataFrame([(0.3, 0), (0.30000000000000004, 1), (0.6, 1), (0.7, 1)], "p double, y int")
    edges = np.linspace(0, 1, 11)
    want = sorted(int(np.searchsorted(edges, p, side="right")) - 1 for p in (0.3, 0.30000000000000004, 0.6, 0.7))
    got = e.calibration_table(df, "p", "y").collect()
    assert sorted(b for r in got for b in [r["bin"]] * r["n"]) == want


def test_threshold_grid_is_the_computed_one(spark):
    df = spark.createDataFrame([(0.15, 1), (0.2, 0)], "p double, y int")
    table = {r["threshold"]: r["flagged"] for r in e.threshold_table(df, "p", "y").collect()}
    want = {round(float(t), 2): int(sum(p >= t for p in (0.15, 0.2))) for t in np.arange(0.05, 0.55, 0.05)}
    assert table == want


def test_class_histograms_have_their_own_range(frame, sample):
    got = e.score_histogram_by_label(frame, "score", "label", 20).toPandas()
    for y in (0, 1):
        values = sample[sample.label == y].score
        counts, _ = np.histogram(values, bins=20)
        density, _ = np.histogram(values, bins=20, density=True)
        part = got[got.label == y].set_index("bin")
        assert part.n.reindex(range(20), fill_value=0).tolist() == list(counts)
        assert np.allclose(part.density.reindex(range(20), fill_value=0.0), density)
