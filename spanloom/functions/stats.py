"""Paired statistics as column expressions; the p-value alone needs a vectorised Python function (no erfc in SQL)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import arrow_column

#: One-sided 5 % point of the normal distribution.
Z95 = 1.6448536269514722


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def paired_difference(n: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Difference of the two hit rates and its standard error, from discordant counts; both 0 for n = 0."""
    d = ratio(b - c, n)
    inside = ratio((b + c).cast("double") - ratio((b - c) * (b - c), n), n * n)
    return d, F.sqrt(F.greatest(inside, F.lit(0.0)))


def mcnemar(b: Column, c: Column) -> Column:
    """Chi-square with continuity correction, 0 without discordant pairs."""
    gap = F.abs(b - c) - 1
    return ratio(gap * gap, b + c)


def equivalent(n: Column, d: Column, se: Column, margin: Column) -> Column:
    """The decision of two one-sided tests at 5 %: both tails clear the margin."""
    floor = F.greatest(se, F.lit(1e-12))
    return (n > 0) & (F.least(margin + d, margin - d) / floor > Z95)


def _tail(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in x])


@arrow_column("double")
def tost_p(n: pa.Array, d: pa.Array, se: pa.Array, margin: pa.Array) -> pa.Array:
    """The larger p-value of the two one-sided tests; 1 for n = 0."""
    n, d, se, margin = (np.asarray(x, dtype=np.float64) for x in (n, d, se, margin))
    se = np.maximum(se, 1e-12)
    p = np.maximum(_tail((margin + d) / se), _tail((margin - d) / se))
    return pa.array(np.where(n > 0, p, 1.0))


@arrow_column("double")
def bootstrap_half_width(found: pa.Array, n: pa.Array) -> pa.Array:
    """Half the width of the 95 % interval of a recall in percent, to one decimal, from 5000 seeded binomial draws; null for n = 0."""
    out = []
    for k, total in zip(found.to_pylist(), n.to_pylist()):
        if not total or k is None:
            out.append(None)
            continue
        draws = np.random.default_rng(20260808).binomial(total, k / total, 5000)
        low, high = np.percentile(draws * 100 / total, [2.5, 97.5])
        out.append(round((high - low) / 2, 1))
    return pa.array(out, pa.float64())
