"""Right-closed bins ``(lo, hi]`` with labels, as a ``when`` chain."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from renewlens.functions.scalars import _col

INF = math.inf

# Bin edges and labels.
TENURE = ([-1, 1, 3, 7, 100], ["0-1yr", "2-3yr", "4-7yr", "8+yr"])
PRICE_4 = ([-INF, -0.01, 0.01, 0.10, INF], ["Decreased", "Flat", "1-10% up", ">10% up"])
PRICE_5 = (
    [-INF, -0.01, 0.01, 0.10, 0.20, INF],
    ["Decreased", "Flat", "1-10% up", "10-20% up", ">20% up"],
)
PRICE_PERCENT = (
    [-INF, -0.01, 0.01, 10, INF],
    ["Decreased", "Flat", "1-10% Increase", "10%+ Increase"],
)
SCORE_DIRECTION = ([-INF, -0.01, 0.01, INF], ["Decreased", "Flat", "Increased"])
FLAG_COUNT = ([-1, 0, 1, 2, 3, 100], ["0", "1", "2", "3", "4+"])


def bucketize_right(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin ``(edges[i], edges[i+1]]``; null and out-of-range values get no label."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin")
    c = _col(c).cast("double")
    out = F.when(c <= float(edges[0]), F.lit(None).cast("string")) if edges[0] != -INF else None
    for hi, label in zip(edges[1:], labels):
        cond = c <= float(hi) if hi != INF else c.isNotNull()
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def bucket_ordinal(c: Column | str, labels: Sequence[str]) -> Column:
    """0-based position of a label, for sorting labelled bins."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), _col(c)), F.lit(0)) - 1


def equal_width_bin(v: Column, lo: Column, step: Column, bins: int) -> Column:
    """0-based bin ``[lo + b * step, lo + (b + 1) * step)``; the last bin also takes its right end.

    The quotient alone can be off by one next to an edge, so it is compared with the edges themselves.
    """
    b = F.floor((v - lo) / step)
    b = b - F.when(v < lo + b * step, 1).otherwise(0) + F.when(v >= lo + (b + 1) * step, 1).otherwise(0)
    return F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).cast("int")


def sentiment_change(delta: Column | str) -> Column:
    delta = _col(delta)
    return F.when(delta < 0, "Worse").when(delta > 0, "Improved").when(delta == 0, "Same")
