"""Files with line breaks inside quotes, against Spark's own whole-file reader."""

import random

import pytest
from pyspark.sql import functions as F

from renewlens.sources import quoted_csv, tables


def plain(spark, path):
    return spark.read.options(header=True, inferSchema=False, **quoted_csv.OPTIONS).csv(path)


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def field(rng):
    kind = rng.randrange(8)
    if kind < 3:
        return str(rng.randrange(1000))
    if kind == 3:
        return ""
    if kind == 4:
        return '"a ""quoted"" word, and a comma"'
    if kind == 5:
        return '""'
    return '"' + "\n".join("line, " * rng.randrange(1, 9) + '""' * rng.randrange(3) for _ in range(rng.randrange(2, 6))) + '"'


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "700")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_whole_file_reader_in_many_tasks(spark, tmp_path, small_splits, end):
    rng = random.Random(7)
    rows = [",".join([str(i), field(rng), field(rng)]) for i in range(600)]
    rows[50] = '50,"' + "one record over many splits\n" * 120 + '",x'
    rows[60:60] = ["", ""]
    path = tmp_path / "data.csv"
    path.write_bytes((end.join(["id,`odd` name,c", *rows]) + (end if end == "\n" else "")).encode())
    got = tables.read_text_csv(spark, str(path), multi_line=True)
    text = quoted_csv.lines(spark, str(path))
    assert text.rdd.getNumPartitions() > 20
    states = quoted_csv.split_states(text)
    assert any(states.values()) and not all(states.values())
    want = plain(spark, str(path))
    assert got.columns == want.columns and got.count() == 600
    assert same(got, want)


def test_several_files_with_headers_and_an_empty_one(spark, tmp_path, small_splits):
    for k in range(4):
        body = "".join(f'{k},"x\ny {i}"\n' for i in range(150 if k < 2 else 0))
        (tmp_path / f"part-{k}.csv").write_text("a,b\n" + body)
    (tmp_path / "part-9.csv").write_text("")
    got = quoted_csv.read_quoted_csv(spark, str(tmp_path))
    assert got.count() == 300 and same(got, plain(spark, str(tmp_path)))
    assert got.where(F.col("b").contains("\n")).count() == 300


def test_quotes_that_are_not_closed(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('a,b\n1,"open\n2,x\n')
    with pytest.raises(Exception, match="not closed"):
        quoted_csv.read_quoted_csv(spark, str(tmp_path / "bad.csv"))
