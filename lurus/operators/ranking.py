"""Ranks by hashed priority within groups of any size, without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of equal width that the priorities of a group are counted in.
CELLS = 4096


def priority(id_col: Column, seed: int | Column = 42) -> Column:
    """A hashed priority of 60 bits, the same in every engine and however the rows are partitioned."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), id_col.cast("string"))), 1, 15), 16, 10).cast("long")


def cell(p: Column) -> Column:
    """The priority's highest 12 bits."""
    return F.shiftright(p, 48).cast("int")


def cell_offsets(counts: DataFrame, group: list[str]) -> DataFrame:
    """counts: (*group, cell, n). Adds `before`: rows of the group in lower cells. At most CELLS rows a group are in one task."""
    w = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def cut_by_rank(df: DataFrame, group: list[str], id_col: str, cuts: DataFrame, seed: int | Column = 42) -> DataFrame:
    """Rows whose rank by priority within their group lies in a cut's [lo, hi), with the cut's columns. Cuts are a few rows for each group.

    Ranks are exact: cells wholly inside a cut need none, only the cells that a cut's edge goes through are sorted.
    """
    rows = df.withColumn("_p", priority(F.col(id_col), seed)).withColumn("cell", cell(F.col("_p")))
    counts = rows.groupBy(*group, "cell").agg(F.count("*").alias("n"))
    ends = cell_offsets(counts, group).withColumn("after", F.col("before") + F.col("n"))
    # a cell with the one cut that holds it all, or with all that meet it
    met = ends.join(cuts, group).where("lo < after and hi > before")
    whole = met.where("lo <= before and hi >= after").drop("n", "before", "after", "lo", "hi")
    edges = met.where("not (lo <= before and hi >= after)")
    on = [*group, "cell"]
    inside = rows.join(whole, on)
    w = Window.partitionBy(*on).orderBy("_p", id_col)
    ranked = rows.join(edges.select(*on, "before").distinct(), on).withColumn("_rank", F.col("before") + F.row_number().over(w) - 1).drop("before")
    cut = ranked.join(edges.drop("n", "before", "after"), on).where("_rank >= lo and _rank < hi").drop("lo", "hi", "_rank")
    return inside.unionByName(cut).drop("_p", "cell")
