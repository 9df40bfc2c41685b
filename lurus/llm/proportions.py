"""Problem 2: a sample that matches target category shares, by mergeable per-category reservoirs.

One pass over the records fills the reservoirs: each task counts the records of every split and category and keeps, of each that has a target, the ids of
lowest hashed priority, as many as the quota can be at most (the targets' largest claim, were all records of one split). Reservoirs of any two tasks
merge by union, and together they hold the quota's lowest priorities of all records, whatever task had which. After the final counts each is trimmed to
its feasible quota, a uniform choice: places come from counts of 4,096 priority cells, and only the cell in which a quota ends is sorted. The records
themselves are not read again. `report` and `sample` rest on the same state.

Quota of a target row: max(min_rows, target_share * sample_fraction * n) rounded up, n being the split's records of known category; a category that
holds fewer gives all it has and is reported as exhausted. Other categories are not raised in its place, which would bend their shares.

Defined results: rows of unknown split or category are not sampled; a target row with nulls is not met by anything and asks for nothing; a target for
an absent category is reported; repeated targets count once; empty tables give empty samples; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurus.llm.ranking import cut_by_rank, priority
from lurus.llm.text import CATEGORIES, category_name, split_name
from lurus.plans.session import importable, staged

SPLITS, NAMES = ("train", "val", "test"), tuple(CATEGORIES.values())
STATE = "place int, id long, p long, n long"
#: Ids that a task gathers beyond a reservoir's bound before it drops those of higher priority.
SLACK = 100_000


def known(df: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(place, id) of records of known split and category; place numbers the pairs of these."""
    at = lambda c, names: F.array_position(F.array(*map(F.lit, names)), c) - 1
    place = at(split_name(F.col("split")), SPLITS) * len(NAMES) + at(category_name(F.col("category")), NAMES)
    return df.select(F.col(id_col).cast("long").alias("id"), place.cast("int").alias("place")).where("place >= 0 and id is not null")


def named(df: DataFrame) -> DataFrame:
    """split and category instead of place."""
    of = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    place = F.col("place")
    return df.withColumn("split", of(SPLITS, F.floor(place / len(NAMES)))).withColumn("category", of(NAMES, place % len(NAMES))).drop("place")


def bounds(targets: DataFrame, records: int) -> dict[int, int]:
    """The most that each place's quota can be: one row for each of the known pairs at most."""
    asked = targets.select("split", "category", "target_share", "sample_fraction", "min_rows").dropna().where(F.col("split").isin(*SPLITS) & F.col("category").isin(*NAMES))
    rows = asked.groupBy("split", "category").agg(F.max(F.col("target_share") * F.col("sample_fraction")).alias("share"), F.max("min_rows").alias("least")).collect()
    return {SPLITS.index(r.split) * len(NAMES) + NAMES.index(r.category): min(records, math.ceil(max(r.least, r.share * records)) + 1) for r in rows}


def _filled(most: dict[int, int]):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (place, id, p): the ids of lowest priority of each place, and a row with null id that counts all."""
        counts: dict[int, int] = {}
        kept: dict[int, list[np.ndarray]] = {}

        def lowest(place: int) -> np.ndarray:
            rows = np.concatenate(kept[place])
            return rows[np.lexsort((rows[:, 0], rows[:, 1]))[: most[place]]]

        for batch in batches:
            places = batch.column(0).to_numpy()
            rows = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1)
            for place in np.unique(places).tolist():
                own = rows[places == place]
                counts[place] = counts.get(place, 0) + len(own)
                if most.get(place):
                    kept.setdefault(place, []).append(own)
                    if sum(map(len, kept[place])) > most[place] + SLACK:
                        kept[place] = [lowest(place)]
        for place, n in counts.items():
            if place in kept:
                rows = lowest(place)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), place, np.int32)), pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.nulls(len(rows), pa.int64())], names=["place", "id", "p", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([n], pa.int64())], names=["place", "id", "p", "n"])

    return fill


def reservoirs(df: DataFrame, targets: DataFrame, id_col: str = "image_id", seed: int = 42) -> DataFrame:
    """(split, category, id, p, n): the mergeable state of all reservoirs, in the shared folder. Rows with an id are kept records, the others counts."""
    importable(df.sparkSession)
    most = bounds(targets, df.count())  # for a table of files their own counts, no scan
    rows = known(df, id_col).select("place", "id", priority(F.col("id"), seed).alias("p"))
    return named(staged(rows.mapInArrow(_filled(most), STATE), "reservoirs"))


def report(state: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: n, available, wanted, quota, exhausted."""
    have = state.where("id is null").groupBy("split", "category").agg(F.sum("n").alias("available"))
    n = have.groupBy("split").agg(F.sum("available").alias("n"))
    asked = targets.select("split", "category", "target_share", "sample_fraction", "min_rows").dropna().distinct()
    rows = asked.join(have, ["split", "category"], "left")
    rows = rows.join(n, "split", "left").fillna(0, ["available", "n"])
    wanted = F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("sample_fraction") * F.col("n"))
    quota = F.least(F.ceil(wanted), F.col("available"))
    return rows.select("split", "category", "n", "available", wanted.alias("wanted"), quota.alias("quota"), (F.col("available") < wanted).alias("exhausted"))


def sample(df: DataFrame, targets: DataFrame, id_col: str = "image_id", seed: int = 42) -> DataFrame:
    """(split, category, id): the sampled rows."""
    state = reservoirs(df, targets, id_col, seed)
    quotas = report(state, targets).groupBy("split", "category").agg(F.max("quota").alias("hi")).where("hi > 0").withColumn("lo", F.lit(0).cast("long"))
    return cut_by_rank(state.where("id is not null").select("split", "category", "id"), ["split", "category"], "id", quotas, seed).select("split", "category", "id")
