"""Stored sketches, deployed models and partial rebuilds."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from renewlens.operators import model as m
from renewlens.operators import profiling as p
from renewlens.operators import sketches as sk
from renewlens.plans import deployment as d
from renewlens.sources import tables as src


@pytest.fixture(scope="module")
def events(spark):
    """Three years with overlapping customers, one of them with a third of all rows, and null keys."""
    rows = spark.range(120_000).selectExpr(
        "cast(2020 + id % 3 as int) as year",
        "case when id % 97 = 0 then null when id % 3 = id % 9 then 'big' else concat('c', (id * 7919) % 40000) end as Co_Ref",
        "case when id % 11 = 0 then null else cast((id * 31) % 10007 as double) end as value",
    )
    return rows.cache()


def test_stored_key_sketches_merge(spark, events, tmp_path):
    sk.key_sketches(events, ["year"]).write.parquet(str(tmp_path / "keys"))
    stored = spark.read.parquet(str(tmp_path / "keys"))
    exact = {r["year"]: r for r in p.distinct_by_group(events, "year").collect()}
    for r in stored.withColumn("n", sk.distinct_keys()).collect():
        assert r["n_rows"] == exact[r["year"]]["n_rows"]
        assert r["n"] == pytest.approx(exact[r["year"]]["n_keys"], rel=0.03)
    total = sk.merge_keys(stored).withColumn("n", sk.distinct_keys()).first()
    assert total["n_rows"] == 120_000
    assert total["n"] == pytest.approx(events.select(F.count_distinct("Co_Ref")).first()[0], rel=0.03)
    # union of stored years is the sketch of their rows
    both = sk.merge_keys(stored.where("year < 2022")).withColumn("n", sk.distinct_keys()).first()["n"]
    assert both == pytest.approx(events.where("year < 2022").select(F.count_distinct("Co_Ref")).first()[0], rel=0.03)


def test_sketched_overlap(events):
    one, two = events.where("year = 2020"), events.where("year = 2021")
    want = p.key_overlap(one, two).first()
    got = sk.sketched_overlap(*(sk.merge_keys(sk.key_sketches(x, ["year"])) for x in (one, two))).first()
    assert got["n_a"] == pytest.approx(want["n_a"], rel=0.03) and got["n_b"] == pytest.approx(want["n_b"], rel=0.03)
    assert abs(got["n_both"] - want["n_both"]) <= 0.03 * max(want["n_a"], want["n_b"])
    few = events.where("Co_Ref < 'c11'")
    small = [sk.merge_keys(sk.key_sketches(few.where(F.col("year") == y), ["year"])) for y in (2020, 2021)]
    exact = p.key_overlap(few.where("year = 2020"), few.where("year = 2021")).first()
    assert tuple(sk.sketched_overlap(*small).first())[:3] == tuple(exact)[:3]


def test_stored_value_sketches_merge_within_their_rank_error(spark, events, tmp_path):
    sk.value_sketches(events, ["year"], "value").write.parquet(str(tmp_path / "values"))
    total = sk.merge_values(spark.read.parquet(str(tmp_path / "values")))
    n = events.where("value is not null").count()
    for q in (0.1, 0.25, 0.5, 0.9):
        cut = total.select(sk.sketched_quantile(q)).first()[0]
        below = events.where(F.col("value") < cut).count() / n
        upto = events.where(F.col("value") <= cut).count() / n
        assert below - 0.015 <= q <= upto + 0.015
    assert sk.value_sketches(events.limit(0), ["year"], "value").count() == 0


@pytest.fixture(scope="module")
def deployed(spark, tmp_path_factory):
    df = spark.range(400).selectExpr(
        "cast(id as string) as Co_Ref", "2024 as Renewal_Year", "cast(id % 7 as double) as a", "cast(id % 5 as int) as b",
        "cast(id % 7 > 3 as int) as churn_label",
    )
    path = str(tmp_path_factory.mktemp("deployed") / "v1")
    params = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.3, "min_child": 1, "grid": [1]}
    model = m.train_gbt(df, ["a", "b"], params)
    return df, path, model, d.deploy(model, df, params, 0.4, path)


def test_scoring_from_a_stored_model(spark, deployed):
    df, path, model, manifest = deployed
    assert d.read_manifest(spark, path) == manifest
    assert manifest.features == [["a", "double"], ["b", "int"]] and "grid" not in manifest.params
    got = {r["Co_Ref"]: r for r in d.score_deployed(df.drop("churn_label").withColumn("more", F.lit(1)), path).collect()}
    want = {r["Co_Ref"]: r[m.SCORE] for r in m.score(df, model).collect()}
    assert len(got) == 400 and all(got[k][m.SCORE] == pytest.approx(v) for k, v in want.items())
    assert all(r["churn_flag"] == int(r[m.SCORE] >= 0.4) for r in got.values())


def test_tables_that_do_not_fit_are_refused(spark, deployed):
    df, path, _, manifest = deployed
    with pytest.raises(ValueError, match="b is missing"):
        d.score_deployed(df.drop("b"), path)
    with pytest.raises(ValueError, match="a is string, not double"):
        d.score_deployed(df.withColumn("a", F.col("a").cast("string")), path)
    other = path + "-other"
    d.deploy(m.train_gbt(df, ["b", "a"], {"n_estimators": 1, "max_depth": 1}), df, {}, 0.5, other)
    spark.read.text(f"{path}/manifest").write.mode("overwrite").text(f"{other}/manifest")
    with pytest.raises(ValueError, match="not the features"):
        d.score_deployed(df, other)
    text = spark.read.text(f"{path}/manifest").select(F.replace("value", F.lit('"version": 1'), F.lit('"version": 9')))
    text.write.mode("overwrite").text(f"{other}/manifest")
    with pytest.raises(ValueError, match="version 9"):
        d.score_deployed(df, other)


def files(path, year):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/Renewal_Year={year}/*.parquet")}


def test_refresh_of_one_year(spark, tmp_path):
    path = str(tmp_path / "features")
    rows = spark.range(60).selectExpr("cast(id as string) as Co_Ref", "cast(2020 + id % 3 as int) as Renewal_Year", "cast(id as int) as n")
    src.write_features(rows, path)
    before = {y: files(path, y) for y in (2020, 2021, 2022)}
    late = rows.withColumn("n", F.when(F.col("Renewal_Year") == 2021, F.col("n") + 100).otherwise(F.col("n")))
    new = spark.range(5).selectExpr("concat('x', id) as Co_Ref", "2023 as Renewal_Year", "cast(null as int) as n")
    src.refresh_features(late.where("Renewal_Year = 2021").unionByName(new), path)
    assert files(path, 2020) == before[2020] and files(path, 2022) == before[2022]
    assert files(path, 2021) != before[2021]
    full = str(tmp_path / "full")
    src.write_features(late.unionByName(new), full)
    key = lambda df: sorted((r["Co_Ref"], r["Renewal_Year"], r["n"]) for r in df.collect())
    assert key(src.read_features(spark, path)) == key(src.read_features(spark, full))
