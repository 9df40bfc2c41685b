"""Confidence gating: when to prefer a hypothesis to its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurus.functions.stats import ratio
from lurus.plans.indexing import row_index
from lurus.plans.session import checkpointed

NO_SCORE = -99.0


def score(column: Column) -> Column:
    """The score as a number; absent ones rank below all."""
    return F.coalesce(column.cast("string").try_cast("double"), F.lit(NO_SCORE))


def gate(source: Column, hyp: Column, score_: Column, tau: Column | float, strict: bool = False) -> Column:
    """The hypothesis where its score reaches (or, strictly, passes) the threshold."""
    return F.when(score_ > tau if strict else score_ >= tau, hyp).otherwise(source)


def guarded(source: Column, hyp: Column, most: float) -> Column:
    """The hypothesis unless it changes more than a share of the source's characters."""
    return F.when(F.levenshtein(source, hyp) / F.greatest(F.length(source), F.lit(1)) <= most, hyp).otherwise(source)


def thresholds(df: DataFrame, score_: str, percentiles: tuple[int, ...] = tuple(range(0, 101, 10))) -> DataFrame:
    """(q, tau): the scores at the percentiles; 0 and 100 are the extremes, the others by the exclusive rule. Fewer than two scores give none.

    Scores are numbered in range partitions; of the numbered ones only the two beside each cut point are looked at.
    """
    rows = row_index(df.select(score_), score_)
    n = rows.count()
    at = {q: (0, 0, 0) if q == 0 else (n - 1, n - 1, 0) if q == 100 else _beside(q, n) for q in percentiles if n >= 2}
    values = {r.i: r[score_] for r in rows.where(F.col("i").isin([i for lo, hi, _ in at.values() for i in (lo, hi)])).collect()}
    return df.sparkSession.createDataFrame([(q, (values[lo] * (100 - d) + values[hi] * d) / 100) for q, (lo, hi, d) in at.items()], "q int, tau double")


def _beside(q: int, n: int) -> tuple[int, int, int]:
    j = min(max(q * (n + 1) // 100, 1), n - 1)
    return j - 1, j, q * (n + 1) - 100 * j


def sweep(df: DataFrame, score_: str, edits_src: str, edits_hyp: str, length: str, taus: DataFrame) -> DataFrame:
    """(q, tau, cer, applied): the corpus error rate at each threshold. One aggregate with a conditional sum for each threshold, so one scan and no join."""
    at = sorted((r.q, r.tau) for r in taus.collect())  # percentiles: 101 rows at most
    over = lambda tau: F.col(score_) >= F.lit(tau)
    sums = [F.struct(F.lit(q).alias("q"), F.lit(tau).alias("tau"), F.sum(F.when(over(tau), F.col(edits_hyp)).otherwise(F.col(edits_src))).alias("edits"), F.count_if(over(tau)).alias("n")) for q, tau in at]
    one = df.agg(F.array(*sums).alias("at"), F.sum(length).alias("len"), F.count("*").alias("rows")) if at else None
    if one is None:
        return df.sparkSession.createDataFrame([], "q int, tau double, cer double, applied double")
    flat = one.select(F.explode("at").alias("x"), "len", "rows").select("x.*", "len", "rows")
    return flat.select("q", "tau", ratio(F.col("edits").cast("double"), F.col("len").cast("double")).alias("cer"), ratio(F.col("n").cast("double"), F.col("rows").cast("double")).alias("applied"))


def best(sweep_: DataFrame, no_correction: Column) -> DataFrame:
    """The first threshold that is strictly better than no correction at all, and its rate; q is null if none is."""
    return sweep_.agg(F.min("cer").alias("cer"), F.min_by("q", F.struct("cer", "q")).alias("q"), F.min_by("tau", F.struct("cer", "q")).alias("tau")).select(
        F.when(F.col("cer") < no_correction, F.col("q")).alias("q"), F.when(F.col("cer") < no_correction, F.col("tau")).alias("tau"), F.least("cer", no_correction).alias("cer")
    )


def running_mean(df: DataFrame, value: str, by: str) -> DataFrame:
    """Adds running: the mean of all rows so far, in the order of a column that identifies rows. Sums start anew in each range partition and are carried on
    by one offset a partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpointed(df.repartitionByRange(n, by).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    offsets = totals.select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    so_far = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_s0", F.coalesce(F.sum(value).over(so_far), F.lit(0.0))).withColumn("_n0", F.count(value).over(so_far))
    return own.join(F.broadcast(offsets), "_part").withColumn("running", F.try_divide(F.col("_s") + F.col("_s0"), F.col("_n") + F.col("_n0"))).drop("_part", "_s", "_n", "_s0", "_n0")
