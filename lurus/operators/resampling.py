"""Uncertainty: bootstrap intervals, paired bootstrap, sign and McNemar tests.

Draws are hashes of (seed, replicate, position), so a replicate is the same in every run, engine and partitioning. Resampling touches counters, never
texts. The counters are staged in the order of their row numbers, and a task makes some of the replicates whole (`operators/draws.py`), so that nothing is
joined or broadcast; `poisson` weights rows in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lurus.functions.stats import binomial_p, f_beta, ratio, uniform
from lurus.operators import draws
from lurus.plans.indexing import row_index
from lurus.plans.session import scratch


def replicates(df: DataFrame, by: str, b: int, seed: int, *sums: str) -> DataFrame:
    """(rep, *sums) of b resamples with replacement of all rows."""
    kinds = df.select(*(F.sum(c).alias(c) for c in sums)).schema
    if unfit := [f.name for f in kinds if f.dataType.typeName() not in ("long", "double")]:
        raise ValueError(f"whole or floating numbers are summed, which {', '.join(unfit)} is not")
    spark, path = df.sparkSession, scratch(df.sparkSession, "counters")
    row_index(df.select(by, *(F.col(c).cast(kinds[c].dataType).alias(c) for c in sums)), by).select("i", *sums).write.option("compression", "zstd").parquet(path)
    n, cores = spark.read.parquet(path).count(), spark.sparkContext.defaultParallelism
    kinds = StructType([StructField("rep", IntegerType()), *kinds])
    if not n:
        return spark.createDataFrame([], kinds)
    reps = spark.range(0, b, 1, max(1, min(b, max(4 * cores, n * b >> 30)))).select(F.col("id").cast("int").alias("rep"))
    return reps.mapInArrow(draws.sums_with(path, n, seed, list(sums)), kinds)


def poisson_replicates(df: DataFrame, by: str, b: int, seed: int, *sums: str) -> DataFrame:
    """The same by Poisson(1) weights: one pass and a map-side combine, whatever the number of rows."""
    u = uniform(seed, F.col("rep"), F.col(by))
    weight = sum(((u > p).cast("int") for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)), start=F.lit(0))
    rows = df.select(by, *sums, F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("rep"))
    return rows.withColumn("_w", weight).groupBy("rep").agg(*(F.sum(F.col(c) * F.col("_w")).alias(c) for c in sums))


def interval(values: Column, inclusive: bool = False) -> tuple[Column, Column]:
    """Percentile interval of sorted replicate values: places int(0.025 m) and int(0.975 m) - 1, or min(int(0.975 m), m - 1)."""
    m = F.size(values)
    hi = F.least(F.floor(0.975 * m), m - 1) if inclusive else F.floor(0.975 * m) - 1
    return F.get(values, F.floor(0.025 * m).cast("int")), F.get(values, hi.cast("int"))


def ratio_interval(df: DataFrame, by: str, num: str, den: str, b: int = 1000, seed: int = 42) -> DataFrame:
    """One row: n, the corpus ratio and its interval; no interval below two rows."""
    point = df.agg(F.count("*").alias("n"), ratio(F.sum(num).cast("double"), F.sum(den).cast("double")).alias("point"))
    values = replicates(df, by, b, seed, num, den).agg(F.sort_array(F.collect_list(ratio(F.col(num).cast("double"), F.col(den).cast("double")))).alias("v"))
    lo, hi = interval(F.col("v"))
    return point.join(values).select("n", "point", F.when(F.col("n") >= 2, lo).alias("lo"), F.when(F.col("n") >= 2, hi).alias("hi"))


def f_interval(df: DataFrame, by: str, b: int = 1000, seed: int = 42, beta: float = 0.5) -> DataFrame:
    """One row: F and its interval of rows with tp, fp, fn; the upper place is min(int(0.975 b), b - 1). Below two rows both ends are the point."""
    score = f_beta(F.col("tp"), F.col("fp"), F.col("fn"), beta)
    point = df.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))).select("n", score.alias("point"))
    values = replicates(df, by, b, seed, "tp", "fp", "fn").agg(F.sort_array(F.collect_list(score)).alias("v"))
    lo, hi = interval(F.col("v"), inclusive=True)
    return point.join(values).select("n", "point", F.when(F.col("n") >= 2, lo).otherwise(F.col("point")).alias("lo"), F.when(F.col("n") >= 2, hi).otherwise(F.col("point")).alias("hi"))


def paired_bootstrap(df: DataFrame, by: str, diff: str, b: int = 5000, seed: int = 42) -> DataFrame:
    """One row: mean difference, interval and p of resampled per-row differences."""
    n = df.count()
    point = df.agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff"))
    means = replicates(df, by, b, seed, diff).select(F.round(F.col(diff) / max(n, 1), 9).alias("m"))  # a sum of differences that cancel out is not above 0
    values = means.agg(F.sort_array(F.collect_list("m")).alias("v"), F.avg((F.col("m") > 0).cast("double")).alias("above"))
    lo, hi = interval(F.col("v"))
    return point.join(values).select("n", "mean_diff", lo.alias("lo"), hi.alias("hi"), (2 * F.least(F.col("above"), 1 - F.col("above"))).alias("p"))


def sign_test(df: DataFrame, a: str, b: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: better (b below a), worse, ties, exact two-sided p without the ties."""
    d = F.col(a) - F.col(b)
    counts = df.agg(F.count_if(d > tolerance).alias("better"), F.count_if(d < -tolerance).alias("worse"), F.count_if(F.abs(d) <= tolerance).alias("ties"))
    return counts.withColumn("p", binomial_p(F.least("better", "worse"), F.col("better") + F.col("worse")))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rows that only a (only b) has exactly right, and the exact p."""
    counts = df.agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("only_a"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("only_b"))
    return counts.withColumn("p", binomial_p(F.least("only_a", "only_b"), F.col("only_a") + F.col("only_b")))
