"""Problem 6: records that are the same but for formatting, by external sort and a scan of adjacent runs.

Canonical records are range-partitioned and sorted by (hash, full key, id); one scan of each partition compares full keys of neighbours and gives
each run its smallest id. A run may cross partition borders (a hot group is cut into several ranges by its ids), so each partition also tells its
first and last key, as a digest of 256 bits; these few rows, one a partition, are stitched on the driver.

Defined results: records with a null, empty or wordless text belong to no group; ids that are null are left out; the smallest id of a group is kept;
repeated ids count as copies of themselves once each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurus.llm.text import canonical
from lurus.plans.session import checkpointed, staged

RUNS = "part int, first_run boolean, kept long, copy long, n_runs long, first_key string, last_key string, last_kept long, head long"


def canonical_records(df: DataFrame, id_col: str, text_cols: tuple[str, str]) -> DataFrame:
    a, b = (canonical(F.col(c)) for c in text_cols)
    keys = df.select(F.col(id_col).cast("long").alias("id"), a.alias("a"), b.alias("b")).where("id is not null and a <> '' and b <> ''")
    key = F.concat_ws("\x01", F.least("a", "b"), F.greatest("a", "b"))
    return keys.select(F.xxhash64(key).alias("h"), key.alias("key"), "id")


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (h, key, id): a row for each record that continues a run, and one row about the partition's ends."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("part", pa.int32()), ("first_run", pa.bool_()), ("kept", pa.int64()), ("copy", pa.int64()), ("n_runs", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string()), ("last_kept", pa.int64()), ("head", pa.int64())])
    last_h = last_key = first_key = head = kept = None
    runs = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        keys = batch.column(1)
        same = np.zeros(n, bool)
        at = np.flatnonzero(h[1:] == h[:-1]) + 1
        if len(at):
            same[at] = pc.equal(keys.take(pa.array(at)), keys.take(pa.array(at - 1))).to_numpy(zero_copy_only=False)
        if last_key is not None and h[0] == last_h:
            same[0] = keys[0].as_py() == last_key
        if first_key is None:
            first_key, head = keys[0].as_py(), int(ids[0])
        heads = np.flatnonzero(~same)
        run = np.cumsum(~same)  # 0: goes on with the run of the batch before
        base = np.concatenate([[kept if kept is not None else 0], ids[heads]])
        at = np.flatnonzero(same)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(run[at] + runs == 1), pa.array(base[run[at]]), pa.array(ids[at]), *(pa.nulls(len(at), t) for t in schema.types[4:])], schema=schema)
        runs += len(heads)
        kept, last_h, last_key = int(base[run[-1]]), h[-1], keys[n - 1].as_py()
    if first_key is not None:
        first_key, last_key = (blake2b(k.encode(), digest_size=32).hexdigest() for k in (first_key, last_key))  # keys may be long; the driver sees digests
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, None, None, None, runs, first_key, last_key, kept, head), schema.types)], schema=schema)


def copies(df: DataFrame, id_col: str, text_cols: tuple[str, str], partitions: int | None = None) -> DataFrame:
    """(kept, copy): each record but the smallest id of its group."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = staged(canonical_records(df, id_col, text_cols), "canonical")
    ordered = records.repartitionByRange(n, "h", "key", "id").sortWithinPartitions("h", "key", "id")
    runs = checkpointed(ordered.mapInArrow(scan_runs, RUNS))
    # one row for each partition, never more than `n`
    fixes, joins, key, kept = [], [], None, None
    for r in runs.where("n_runs is not null").orderBy("part").collect():
        if r.first_key == key:
            fixes.append((r.part, kept))
            joins.append((kept, r.head))
        if r.first_key != key or r.n_runs > 1:
            kept = r.last_kept
        key = r.last_key
    found = runs.where("n_runs is null")
    if fixes:
        fix = F.broadcast(spark.createDataFrame(fixes, "part int, true_kept long"))
        found = found.join(fix, "part", "left").withColumn("kept", F.when(F.col("first_run"), F.coalesce("true_kept", "kept")).otherwise(F.col("kept")))
        return found.select("kept", "copy").union(spark.createDataFrame(joins, "kept long, copy long"))
    return found.select("kept", "copy")


def collapsed(df: DataFrame, id_col: str, text_cols: tuple[str, str]) -> DataFrame:
    """(id, copies): one row for each group, with the number of its records; records that belong to no group stand alone."""
    pairs = checkpointed(copies(df, id_col, text_cols))
    counts = pairs.groupBy(F.col("kept").alias("id")).agg((F.count("*") + 1).alias("copies"))
    ids = df.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    return ids.join(pairs.select(F.col("copy").alias("id")), "id", "left_anti").join(counts, "id", "left").select("id", F.coalesce("copies", F.lit(1)).alias("copies"))
