"""Column builders for statistics: hashed draws, F scores, exclusive percentiles, exact binomial tails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | int | str) -> Column:
    """An integer in [0, 2**32) from the md5 of the parts: the same in every engine and for every partitioning."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in columns))), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | int | str) -> Column:
    return draw(*parts) / F.lit(float(2**32))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, where Spark would else compute it at every mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def four_uniforms(*parts: Column | int | str) -> Column:
    """A struct a, b, c, d of independent numbers in [0, 1) from one md5."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    h = F.md5(F.concat_ws("|", *(c.cast("string") for c in columns)))
    return let(h, lambda x: F.struct(*((F.conv(F.substring(x, 1 + 8 * k, 8), 16, 10).cast("double") / float(2**32)).alias(n) for k, n in enumerate("abcd"))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 0.5) -> Column:
    p, r, w = ratio(tp, tp + fp), ratio(tp, tp + fn), beta * beta
    return ratio((1 + w) * p * r, w * p + r)


def exclusive_percentile(ascending: Column, i: Column) -> Column:
    """Cut point i of 100 of a sorted array of two or more values, by the exclusive rule: position i * (n + 1) / 100, held within the data."""
    n = F.size(ascending)
    j = F.least(F.greatest(F.floor(i * (n + 1) / 100), F.lit(1)), n - 1).cast("int")
    d = i * (n + 1) - 100 * j
    return (F.element_at(ascending, j) * (100 - d) + F.element_at(ascending, j + 1) * d) / 100


def place_of(ascending: Column, share: float) -> Column:
    """The value at place int(share * n) of a sorted array, counted from 0: latency medians and tails are read so."""
    return F.get(ascending, F.floor(share * F.size(ascending)).cast("int"))


def binomial_p(k: Column, n: Column) -> Column:
    """Exact two-sided p of k or fewer of n fair coins, at most 1; n = 0 gives 1. Summed in logs."""
    start = F.struct((-n * F.log(F.lit(2.0))).alias("lt"), F.lit(0.0).alias("acc"))
    step = lambda s, i: F.struct((s["lt"] + F.log((n - i) / (i + 1.0))).alias("lt"), (s["acc"] + F.exp(s["lt"])).alias("acc"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), start, step)["acc"]))
