"""Splits and samples by hashed order. The same rows are drawn whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurus.functions.stats import draw
from lurus.functions.text import key_form
from lurus.operators.ranking import cut_by_rank
from lurus.operators.resources import small
from lurus.plans.indexing import row_index


def hashed(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in columns)))


def sample_per_group(df: DataFrame, group: str, id_col: str, n: int | Column, seed: int = 42) -> DataFrame:
    """Up to n random rows of each group. Ranks beyond n are dropped before the shuffle (window group limit)."""
    w = Window.partitionBy(group).orderBy(hashed(seed, id_col), id_col)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def stratified_split(df: DataFrame, group: str, id_col: str, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds part: of each group the first max(1, int(n * share)) in hashed order for val and test each, the rest for train.

    Places in a group come from counts of hashed cells, so that a group of any size is ranked in many tasks: only rows within a cell are sorted.
    """
    p = draw(seed, F.col(id_col))
    rows = df.withColumn("_p", p).withColumn("_cell", F.shiftright("_p", 22).cast("int"))
    cells = rows.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(group, "_cell", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("_all"))
    within = Window.partitionBy(group, "_cell").orderBy("_p", id_col)
    same = F.col("r._cell").eqNullSafe(F.col("c._cell")) & F.col(f"r.{group}").eqNullSafe(F.col(f"c.{group}"))
    ranked = rows.withColumn("_row", F.row_number().over(within)).alias("r").join(cells.alias("c"), same).select("r.*", "c._before", "c._all")
    place = F.col("_before") + F.col("_row")
    n_val, n_test = (F.greatest(F.lit(1), F.floor(F.col("_all") * F.lit(x))) for x in (val, test))
    part = F.when(place <= n_val, "val").when(place <= n_val + n_test, "test").otherwise("train")
    return ranked.withColumn("part", part).drop("_p", "_cell", "_row", "_before", "_all")


def budget(weights: DataFrame, name: str, weight: str, total: int, remainder_to_first: bool = True) -> DataFrame:
    """(name, budget): int(total * weight) with the rest for the first name, or each rounded. A handful of rows."""
    if not remainder_to_first:
        return weights.select(name, F.round(F.col(weight) * total).cast("long").alias("budget"))
    base = weights.select(name, F.floor(F.col(weight) * total).alias("budget"))
    rest = base.agg((F.lit(total) - F.sum("budget")).alias("rest"), F.min(name).alias("first"))
    return base.join(F.broadcast(rest)).select(name, (F.col("budget") + F.when(F.col(name) == F.col("first"), F.col("rest")).otherwise(0)).alias("budget"))


def with_replacement(df: DataFrame, by: str, k: int, seed: int = 42) -> DataFrame:
    """k draws with replacement: (k, *columns)."""
    rows = row_index(df, by)
    n = rows.count()
    draws = df.sparkSession.range(k).select(F.col("id").alias("k"), (draw(seed, F.col("id")) % max(n, 1)).alias("i"))
    return small(draws).join(rows, "i").drop("i")


def first_of_key(df: DataFrame, text: str, id_col: str, seed: int = 42) -> DataFrame:
    """One row for each text key, the first in hashed order, by an aggregate with map-side combine."""
    rest = [c for c in df.columns]
    pick = F.min_by(F.struct(*rest), F.struct(hashed(seed, id_col), F.col(id_col)))
    return df.groupBy(key_form(F.col(text)).alias("_key")).agg(pick.alias("_row")).select("_row.*")


def unused(df: DataFrame, text: str, used: DataFrame, used_text: str) -> DataFrame:
    """Rows whose text is not among the used ones, by key."""
    keys = used.select(key_form(F.col(used_text)).alias("_key")).where("_key is not null").distinct()
    return df.withColumn("_key", key_form(F.col(text))).join(keys, "_key", "left_anti").drop("_key")


def take_budget(df: DataFrame, group: str, budgets: DataFrame, id_col: str, ok: Column, seed: int = 42) -> DataFrame:
    """Of each group the first rows in hashed order that are fine, up to its budget (group, budget). No group is sorted in one task."""
    cuts = budgets.select(group, F.lit(0).cast("long").alias("lo"), F.col("budget").cast("long").alias("hi")).where("hi > 0")
    return cut_by_rank(df.where(ok), [group], id_col, cuts, seed).select(*df.columns)


def shuffled(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hashed(seed, id_col), id_col)
