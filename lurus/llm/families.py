"""Problem 3: splits that keep related records together, by distributed union-find and greedy assignment.

Every task first links its own records into a local forest (same target sentence, or parent). Forests are then merged in rounds: links go to the home
partition of their child, where forests that share a record grow together; each partition subscribes to the roots it holds, so a root that got a
parent elsewhere passes it on once for each partition, never once for each record. A group that holds a third of all rows is thus a few rows for each
task from the first step on. The forest is final when every record has one root and no root has a parent; roots are the smallest ids.

Defined results: a null or wordless sentence links nothing; a parent that is no record links nothing; null ids are left out; repeated ids are one
record; an empty table has no families; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurus.llm.ranking import cut_by_rank
from lurus.llm.text import canonical
from lurus.plans.session import checkpointed, importable


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the smallest node of each one's component: hooking of larger roots under smaller ones, then path compression."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while len(x):
        x, y = parent[x], parent[y]
        open_ = x != y
        x, y = x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return nodes, nodes[parent]


def local_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's (id, h1, h2, parent): links of its local forest, and for each sentence the root that stands for it here."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    ids = t["id"].to_numpy()
    parents = t["parent"].to_pandas().to_numpy(np.float64, na_value=np.nan)
    has = np.flatnonzero(~np.isnan(parents))
    parent_ids = t["parent"].drop_null().to_numpy()
    keyed = np.flatnonzero(t["h1"].is_valid().to_numpy())
    h1, h2 = t["h1"].drop_null().to_numpy(), t["h2"].drop_null().to_numpy()
    order = np.lexsort((ids[keyed], h2, h1))
    k, h1, h2 = keyed[order], h1[order], h2[order]
    new = np.ones(len(k), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    firsts = ids[k[new]]
    stands = firsts[np.cumsum(new) - 1] if len(k) else ids[k]
    nodes, roots = union_find(np.concatenate([ids[k][~new], ids[has]]), np.concatenate([stands[~new], parent_ids]))
    links = nodes != roots
    if len(nodes):
        at = np.minimum(np.searchsorted(nodes, firsts), len(nodes) - 1)
        firsts = np.where(nodes[at] == firsts, roots[at], firsts)
    yield pa.RecordBatch.from_arrays([pa.array(nodes[links]), pa.array(roots[links]), pa.nulls(links.sum(), pa.int64()), pa.nulls(links.sum(), pa.int64())], names=["x", "r", "h1", "h2"])
    yield pa.RecordBatch.from_arrays([pa.nulls(len(firsts), pa.int64()), pa.array(firsts), pa.array(h1[new]), pa.array(h2[new])], names=["x", "r", "h1", "h2"])


def merge_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's links (x, r): the links of their joint forest, and its roots (x is null)."""
    part = TaskContext.get().partitionId()
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    nodes, roots = union_find(t["x"].to_numpy(), t["r"].to_numpy())
    links = nodes != roots
    tops = np.unique(roots)
    for x, r in ((pa.array(nodes[links]), pa.array(roots[links])), (pa.nulls(len(tops), pa.int64()), pa.array(tops))):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), part, np.int32)), x, r], names=["part", "x", "r"])


def components(links: DataFrame, partitions: int | None = None) -> DataFrame:
    """(x, r): of each node but the smallest of its component, that smallest node. links: (x, r), any direction, checkpointed or cheap."""
    spark = links.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    home = lambda e: e.select(F.pmod(F.xxhash64("x"), F.lit(n)).cast("int").alias("part"), "x", "r")
    sent = home(links)
    while True:
        out = checkpointed(sent.repartitionById(n, F.col("part")).mapInArrow(merge_forests, "part int, x long, r long"))
        forest = out.where("x is not null").select("x", "r").distinct()
        wanted = out.where("x is null").select("part", F.col("r").alias("x"))
        lower = wanted.join(forest, "x").select("part", "x", "r")
        torn = forest.groupBy("x").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo <> hi")
        if lower.select("x").union(torn.select("x")).isEmpty():
            return forest
        sent = home(forest).union(lower)


def family_links(df: DataFrame, id_col: str, text_col: str, parent_col: str) -> DataFrame:
    """(x, r) links between records with the same sentence, or of which one is the other's parent."""
    importable(df.sparkSession)
    text = canonical(F.col(text_col))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.col(parent_col).cast("long").alias("parent")).where("id is not null")
    known = df.select(F.col(id_col).cast("long").alias("parent"))
    child = df.select(F.col(id_col).cast("long").alias("x"), F.col(parent_col).cast("long").alias("parent")).where("x is not null and parent is not null and x <> parent")
    by_parent = child.join(known, "parent", "left_semi").select("x", F.col("parent").alias("r"))
    worded = F.col("t") != ""
    hashed = rows.select("id", F.when(worded, F.xxhash64("t")).alias("h1"), F.when(worded, F.xxhash64(F.lit(7), F.col("t"))).alias("h2"), F.lit(None).cast("long").alias("parent"))
    local = checkpointed(hashed.mapInArrow(local_links, "x long, r long, h1 long, h2 long"))
    by_text = local.where("h1 is not null").groupBy("h1", "h2").agg(F.min("r").alias("m"), F.collect_set("r").alias("rs")).where(F.size("rs") > 1)
    return local.where("x is not null").select("x", "r").union(by_text.select(F.explode("rs").alias("x"), F.col("m").alias("r")).where("x <> r")).union(by_parent)


def families(df: DataFrame, id_col: str = "image_id", text_col: str = "trg_text", parent_col: str = "parent_image_id") -> DataFrame:
    """(family_id, id): each record but the smallest of its family."""
    return components(family_links(df, id_col, text_col, parent_col)).select(F.col("r").alias("family_id"), F.col("x").alias("id"))


def greedy_quotas(classes: list[tuple[int, int]], targets: list[tuple[str, float]]) -> dict[int, list[int]]:
    """How many groups of each size every split gets when groups, largest first, go to the split furthest below its target.

    Groups of one size are interchangeable, so a class of many is poured in bulk down to a common level and only its last few are dealt singly.
    """
    total = sum(size * n for size, n in classes)
    lack = [share * total for _, share in targets]
    out = {}
    for size, n in sorted(classes, reverse=True):
        got, left = [0] * len(lack), n
        while left > 64 * len(lack):
            level = _level(lack, size * (left - 32 * len(lack)))
            step = [max(0, int((x - level) // size)) for x in lack]
            if not sum(step) or sum(step) > left:
                break
            got, left = [g + s for g, s in zip(got, step)], left - sum(step)
            lack = [x - s * size for x, s in zip(lack, step)]
        for _ in range(left):
            i = max(range(len(lack)), key=lambda j: (lack[j], -j))
            got[i] += 1
            lack[i] -= size
        out[size] = got
    return out


def _level(lack: list[float], volume: float) -> float:
    """The level down to which `volume` lowers the highest of `lack`."""
    xs = sorted(lack, reverse=True)
    for i in range(1, len(xs) + 1):
        level = (sum(xs[:i]) - volume) / i
        if i == len(xs) or level >= xs[i]:
            return level
    return xs[-1]


def assign_splits(df: DataFrame, targets: DataFrame, id_col: str = "image_id", text_col: str = "trg_text", parent_col: str = "parent_image_id") -> DataFrame:
    """(id, family_id, split): every record, all of a family in one split, shares as near to the targets as whole families allow.

    targets: (split, target_share), a handful of rows. The number of distinct family sizes, all that the driver sees of the families, is at most the
    square root of twice the number of records.
    """
    wanted = [(r.split, float(r.target_share)) for r in targets.where("split is not null and target_share is not null").orderBy("split").collect()]  # one row for each split
    if not wanted:
        raise ValueError("no split has a target share")
    ids = df.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    member = checkpointed(ids.join(families(df, id_col, text_col, parent_col), "id", "left").select("id", F.coalesce("family_id", "id").alias("family_id")))
    sizes = checkpointed(member.groupBy("family_id").agg(F.count("*").alias("size")))
    classes = [(r.size, r.n) for r in sizes.groupBy("size").agg(F.count("*").alias("n")).select("size", "n").collect()]
    quotas = greedy_quotas(classes, wanted)
    cuts = [(size, split, sum(got[:i]), sum(got[: i + 1])) for size, got in quotas.items() for i, (split, _) in enumerate(wanted) if got[i]]
    placed = cut_by_rank(sizes, ["size"], "family_id", df.sparkSession.createDataFrame(cuts, "size long, split string, lo long, hi long"))
    return member.join(placed.select("family_id", "split"), "family_id").select("id", "family_id", "split")
