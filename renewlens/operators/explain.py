"""Additive per-feature contributions of a boosted tree model, and the reports built on them.

The contributions are Shapley values under the trees' own cover (path-dependent form, Lundberg et al.,
"Consistent individualized feature attribution for tree ensembles"). For one leaf only the features on
its path matter. With z the share of cover that follows the path at a feature, and o 1 where the row
follows it itself, feature j of m gets value * (o_j - z_j) times the integral over t from 0 to 1 of the
product of z_i (1 - t) + o_i t over the other features i. That product is a polynomial in t of degree
m - 1, so m / 2 points of Gauss and Legendre give it exactly, and running products from both sides give
all features of a path at once: the work grows with leaves times path length, at any depth.

The node table becomes a table of leaves, tree by tree, in Spark. Blocks of leaves of a bounded size go
to the tasks, one after the other, and add to partial sums that are staged between them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from math import factorial
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.functions.scalars import quoted
from renewlens.operators.model import booster, feature_names
from renewlens.session import shared_dir, stage

MAX_TABLE_FEATURES = 8
#: Path entries of one block of leaves (about 40 bytes each), and numbers worked on at once in a task.
BLOCK_ENTRIES, WORK = 500_000, 1 << 20
CONTRIBUTIONS = "contributions"
BASE = "base_value"
#: The booster's probability is 1 / (1 + e^(-2 margin)), so twice the margin is the log-odds.
MARGIN_TO_ODDS = 2.0


def tree_table(spark: SparkSession, model: PipelineModel, path: str | None = None) -> DataFrame:
    """Nodes of all trees as rows, read back from the saved booster (saved first without a path)."""
    if path is None:
        path = f"{shared_dir(spark)}/trees-{uuid4().hex}"
        booster(model).write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    n = nodes.select(F.col("nodeData.*"), "treeID")
    return n.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
        F.col("prediction"),
        F.element_at("impurityStats", 1).alias("cover"),
    )


def path_contributions(one: np.ndarray, zero: Sequence[float], value: float) -> np.ndarray:
    """Contribution of one leaf to each path feature, for every row of ``one``, by sums over orderings.

    This and the two functions below work out a small model in one process in another way; the tests
    hold them against the distributed one.

    ``zero[j]`` is the share of cover that follows the path at feature j; ``one[r, j]`` is 1 when row r
    itself follows it. The average over orderings groups the other features by how many of them are
    known: those sums are the coefficients of prod (zero_i + one_i t).
    """
    rows, m = one.shape
    weight = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
    out = np.zeros((rows, m))
    for j in range(m):
        poly = np.zeros((rows, m))
        poly[:, 0] = 1.0
        for i in range(m):
            if i != j:
                poly[:, 1:] = poly[:, 1:] * zero[i] + poly[:, :-1] * one[:, [i]]
                poly[:, 0] *= zero[i]
        out[:, j] = (poly @ weight) * (one[:, j] - zero[j]) * value
    return out


def _pattern_table(zero: Sequence[float], value: float) -> np.ndarray | None:
    """Contributions for all 2^m patterns; None for paths too long to tabulate."""
    m = len(zero)
    if m > MAX_TABLE_FEATURES:
        return None
    patterns = (np.arange(2**m)[:, None] >> np.arange(m) & 1).astype(float)
    return path_contributions(patterns, zero, value)


def leaf_tables(nodes: pd.DataFrame, tree_weights: Sequence[float], scale: float = 2.0):
    """Per leaf: path features, their intervals (lo, hi], pattern table, shares and value; then the base.

    ``scale`` 2 turns the booster's margin into log-odds, because its probability is 1/(1+e^(-2m)).
    """
    leaves, base = [], 0.0
    for tree, part in nodes.groupby("tree"):
        rows = {int(r.node): r for r in part.itertuples()}
        weight = scale * tree_weights[int(tree)]
        stack = [(0, {})]
        while stack:
            node, path = stack.pop()
            row = rows[node]
            if row.left < 0:
                zero = [z for _, _, z in path.values()]
                value = weight * row.prediction
                base += value * float(np.prod(zero))
                if path:
                    leaves.append((
                        list(path),
                        [lo for lo, _, _ in path.values()],
                        [hi for _, hi, _ in path.values()],
                        _pattern_table(zero, value),
                        zero,
                        value,
                    ))
                continue
            for child, is_left in ((int(row.left), True), (int(row.right), False)):
                lo, hi, z = path.get(row.feature, (-np.inf, np.inf, 1.0))
                share = rows[child].cover / row.cover if row.cover else 0.0
                if is_left:
                    hi = min(hi, row.threshold)
                else:
                    lo = max(lo, row.threshold)
                stack.append((child, {**path, row.feature: (lo, hi, z * share)}))
    return leaves, base


def contributions_of(x: np.ndarray, leaves) -> np.ndarray:
    """Contribution matrix (rows x features) of a batch."""
    out = np.zeros_like(x, dtype=float)
    for features, lo, hi, table, zero, value in leaves:
        cols = x[:, features]
        inside = (cols > lo) & (cols <= hi)
        if table is None:
            out[:, features] += path_contributions(inside.astype(float), zero, value)
        else:
            out[:, features] += table[inside @ (1 << np.arange(len(features)))]
    return out


LEAF_SCHEMA = (
    "tree int, leaf int, features array<int>, low array<double>, high array<double>, "
    "zero array<double>, prediction double"
)


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """Leaves of the node table with their paths: features, intervals (low, high], cover shares, prediction.

    A feature that comes again on a path has one entry: the common interval and the product of shares.
    Each tree is one group; a leaf at the root has an empty path.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {int(r.node): r for r in pdf.itertuples()}
        out, stack = [], [(0, {})]
        while stack:
            node, path = stack.pop()
            row = rows[node]
            if row.left < 0:
                low, high, zero = (list(x) for x in zip(*path.values())) if path else ([], [], [])
                out.append((int(row.tree), node, list(path), low, high, zero, float(row.prediction)))
                continue
            for child, is_left in ((int(row.left), True), (int(row.right), False)):
                low, high, z = path.get(int(row.feature), (-np.inf, np.inf, 1.0))
                share = rows[child].cover / row.cover if row.cover else 0.0
                bounds = (low, min(high, row.threshold)) if is_left else (max(low, row.threshold), high)
                stack.append((child, {**path, int(row.feature): (*bounds, z * share)}))
        return pd.DataFrame(out, columns=["tree", "leaf", "features", "low", "high", "zero", "prediction"])

    return nodes.groupBy("tree").applyInPandas(run, LEAF_SCHEMA)


class Leaves:
    """A block of leaves as arrays, by number of features on the path."""

    def __init__(self, rows: Sequence, weights: Sequence[float], scale: float):
        self.base = 0.0
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        found: dict[int, list] = {}
        for r in rows:
            value = scale * weights[r["tree"]] * r["prediction"]
            self.base += value * float(np.prod(r["zero"]))
            found.setdefault(len(r["features"]), []).append((r["features"], r["low"], r["high"], r["zero"], value))
        for m, leaves in found.items():
            if m:
                self.by_length[m] = tuple(np.array(x) for x in zip(*leaves))

    def add_to(self, out: np.ndarray, x: np.ndarray) -> None:
        """Add the contributions of these leaves for the rows ``x`` to ``out`` (features x rows)."""
        for m, (features, low, high, zero, value) in self.by_length.items():
            points, weights = np.polynomial.legendre.leggauss(-(-m // 2))
            points, weights = (points + 1) / 2, weights / 2
            leaves = max(1, WORK // (m * len(points) * max(1, len(x))))
            for at in range(0, len(features), leaves):
                part = slice(at, at + leaves)
                cols = x[:, features[part]]  # rows, leaves, m
                one = ((cols > low[part]) & (cols <= high[part])).astype(float)
                factor = zero[part][..., None] * (1 - points) + one[..., None] * points
                before, after = np.ones_like(factor), np.ones_like(factor)
                np.cumprod(factor[:, :, :-1], axis=2, out=before[:, :, 1:])
                after[:, :, :-1] = np.cumprod(factor[:, :, :0:-1], axis=2)[:, :, ::-1]
                each = ((before * after) @ weights) * (one - zero[part]) * value[part][:, None]
                np.add.at(out, features[part].ravel(), each.reshape(len(x), -1).T)


def leaf_blocks(leaves: DataFrame, entries: int = BLOCK_ENTRIES) -> Iterator[list]:
    """Leaves in order of their trees, in blocks of at most ``entries`` path entries (one tree at least).

    Only the sizes of the trees and one block at a time come to the driver.
    """
    sizes = leaves.groupBy("tree").agg(F.sum(F.size("features") + 1).alias("n")).orderBy("tree").collect()
    first, room = 0, entries
    for k, r in enumerate(sizes):
        if k > first and room < r["n"]:
            yield leaves.where(F.col("tree").between(sizes[first]["tree"], sizes[k - 1]["tree"])).collect()
            first, room = k, entries
        room -= r["n"]
    if sizes:
        yield leaves.where(F.col("tree") >= sizes[first]["tree"]).collect()


def explain(
    df: DataFrame,
    model: PipelineModel,
    keep: Sequence[str] = ("Co_Ref",),
    booster_path: str | None = None,
    block_entries: int = BLOCK_ENTRIES,
) -> DataFrame:
    """``keep`` columns, the contribution array (in feature order) and the base value, per row.

    Contributions plus base equal the log-odds of the predicted probability. A model of any size is
    worked through in blocks; with more than one, the partial sums are staged between them.
    """
    spark = df.sparkSession
    names = feature_names(model)
    weights = list(booster(model).treeWeights)
    leaves = stage(leaf_paths(tree_table(spark, model, booster_path)))
    kept = [f"_k{i}" for i in range(len(keep))]
    inputs = df.select(
        *[F.col(quoted(c)).alias(k) for c, k in zip(keep, kept)],
        F.array(*[F.col(quoted(c)).cast("double") for c in names]).alias("_x"),
        F.lit(None).cast("array<double>").alias("_sum"),
    )
    base = 0.0
    for number, rows in enumerate(leaf_blocks(leaves, block_entries)):
        block = Leaves(rows, weights, MARGIN_TO_ODDS)
        base += block.base
        shared = spark.sparkContext.broadcast(block)
        inputs = _add_block(inputs if number == 0 else stage(inputs), shared, len(names))
    return inputs.select(
        *[F.col(k).alias(c) for c, k in zip(keep, kept)], F.col("_sum").alias(CONTRIBUTIONS), F.lit(float(base)).alias(BASE)
    )


def _add_block(inputs: DataFrame, shared: Broadcast, n_features: int) -> DataFrame:
    """Rows with the contributions of one more block of leaves in ``_sum``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("_x").flatten().to_numpy(zero_copy_only=False)
            x = flat.astype(float).reshape(batch.num_rows, n_features)
            before = batch.column("_sum").flatten().to_numpy(zero_copy_only=False)
            out = before.astype(float).reshape(-1, n_features).T.copy() if len(before) else np.zeros((n_features, len(x)))
            shared.value.add_to(out, x)
            ends = np.arange(len(x) + 1, dtype=np.int32) * n_features
            sums = pa.ListArray.from_arrays(ends, np.ascontiguousarray(out.T).ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sums], names=batch.schema.names)

    return inputs.mapInArrow(run, inputs.schema)


def top_reasons(explained: DataFrame, names: Sequence[str], n: int = 3) -> DataFrame:
    """Adds ``top_reasons``: the n largest contributions by size, with their direction.

    A sort inside the row's own array; equal sizes go by feature name.
    """
    labels = F.array(*[F.lit(c) for c in names])
    pairs = F.zip_with(
        CONTRIBUTIONS,
        labels,
        lambda v, c: F.struct((-F.abs(v)).alias("size"), c.alias("name"), (v > 0).alias("up")),
    )
    text = F.transform(
        F.slice(F.array_sort(pairs), 1, n),
        lambda p: F.concat(
            p["name"], F.when(p["up"], " (increases risk)").otherwise(" (decreases risk)")
        ),
    )
    return explained.withColumn("top_reasons", F.array_join(text, " | "))


def contribution_points(
    explained: DataFrame, names: Sequence[str], keep: Sequence[str] = ("Co_Ref",)
) -> DataFrame:
    """Long table (key, feature, contribution), the data behind a summary plot."""
    labels = F.array(*[F.lit(c) for c in names])
    return explained.select(*keep, F.posexplode(CONTRIBUTIONS).alias("pos", "contribution")).select(
        *keep, F.element_at(labels, F.col("pos") + 1).alias("feature"), "contribution"
    )


def global_importance(
    explained: DataFrame, names: Sequence[str], k: int | None = None
) -> DataFrame:
    """Mean absolute contribution per feature; one wide aggregate, no explode."""
    row = explained.agg(*[
        F.avg(F.abs(F.element_at(CONTRIBUTIONS, i + 1))).alias(f"m_{i}")
        for i in range(len(names))
    ])
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{i}").alias("mean_abs"))
        for i, c in enumerate(names)
    ])
    out = row.select(F.inline(entries)).orderBy(F.desc("mean_abs"), "feature")
    return out if k is None else out.limit(k)
