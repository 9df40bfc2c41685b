"""Checks and cleaning of a parallel corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurus.functions.stats import ratio
from lurus.functions.text import squeeze, stripped


def shares(df: DataFrame, group: str, expected: DataFrame, weight: str, tolerance: float = 0.05) -> DataFrame:
    """(group, n, share, expected, ok): shares against expected weights; groups on either side alone count as zero on the other."""
    have = df.groupBy(group).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    rows = have.join(expected.select(group, F.col(weight).alias("expected")), group, "full").join(F.broadcast(total)).fillna(0, ["n", "expected"])
    share = ratio(F.col("n").cast("double"), F.col("_all").cast("double"))
    return rows.select(group, "n", share.alias("share"), "expected", (F.abs(share - F.col("expected")) <= tolerance).alias("ok"))


def length_stats(text: str, lo: int, hi: int) -> list[Column]:
    n = F.length(text)
    return [F.count(text).alias("n"), F.avg(n).alias("mean_len"), F.median(n).alias("median_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.count_if(squeeze(F.col(text)) == "").alias("empty"), ratio(F.count_if(n.between(lo, hi)).cast("double"), F.count(text).cast("double")).alias("in_range")]


def duplicate_rate(*columns: str) -> list[Column]:
    whole = F.struct(*columns)
    distinct = F.count_distinct(whole)
    return [F.count("*").alias("n"), distinct.alias("n_distinct"), (1 - ratio(distinct.cast("double"), F.count("*").cast("double"))).alias("dup_rate")]


def identical(src: str, trg: str) -> Column:
    """Whether target and source are the same but for white space at the ends."""
    return F.coalesce(stripped(F.col(src)) == stripped(F.col(trg)), F.lit(False))


def clean(df: DataFrame, src: str, trg: str) -> DataFrame:
    """Pairs that differ and have both sides."""
    return df.where(~identical(src, trg) & (squeeze(F.coalesce(src, F.lit(""))) != "") & (squeeze(F.coalesce(trg, F.lit(""))) != ""))


def clean_counts(df: DataFrame, group: str, src: str, trg: str) -> DataFrame:
    """(group, before, removed, after)."""
    keep = ~identical(src, trg) & (squeeze(F.coalesce(src, F.lit(""))) != "") & (squeeze(F.coalesce(trg, F.lit(""))) != "")
    return df.groupBy(group).agg(F.count("*").alias("before"), F.count_if(~keep).alias("removed"), F.count_if(keep).alias("after"))


def checks(df: DataFrame, rules: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """(check_name, value, status) of named aggregates: pass up to the first bound, warn up to the second, else fail."""
    one = df.agg(*(c.alias(n) for n, (c, _, _) in rules.items()))
    row = F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).cast("double").alias("value"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for n, (_, a, b) in rules.items())))
    status = F.when(F.col("value").isNull(), "skip").when(F.col("value") <= F.col("a"), "pass").when(F.col("value") <= F.col("b"), "warn").otherwise("fail")
    return one.select(row.alias("r")).select("r.*").select("check_name", "value", status.alias("status"))


def columns_missing(df: DataFrame, needed: dict[str, tuple[str, ...]]) -> list[str]:
    """Needed columns that the frame has under none of their names, regardless of case."""
    have = {c.lower() for c in df.columns}
    return [n for n, others in needed.items() if not have & {n.lower(), *(o.lower() for o in others)}]


def columns_extra(df: DataFrame, needed: dict[str, tuple[str, ...]]) -> list[str]:
    """Columns of the frame that no needed column goes by."""
    known = {x.lower() for n, others in needed.items() for x in (n, *others)}
    return [c for c in df.columns if c.lower() not in known]


def file_integrity(df: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """One row: how many listed files are missing or empty, sizes, and what all rows would take at the mean size. files: (name, length), as from binaryFile."""
    name = F.regexp_extract(F.col(path), r"([^/\\]+)$", 1)
    rows = df.select(name.alias("name")).join(files, "name", "left")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("length").isNull()).alias("missing"), F.count_if(F.col("length") == 0).alias("empty"), F.avg("length").alias("mean_size"), F.min("length").alias("min_size"), F.max("length").alias("max_size"), (F.avg("length") * F.count("*")).alias("estimated_bytes"))
