"""Problem 4: how often every distinct term occurs and in how many records, by recursive radix spilling.

A term is a longest run of letters and digits, in lower case. Records are made distinct, split into terms and added up within each map task first, so a
term that is in every record is a few rows a task. These partial counts are spilled to the shared folder, a folder for each value of the highest bits of
their term's hash; a folder of more than `limit` rows is spilled anew by its next bits, again and again, until each fits a task. Each task then reads its
folders and DuckDB adds them up out of core: nothing is shuffled twice but what is split further, and all that the driver sees are the folders' names and
sizes. Terms of equal hash stay together however deep the split; of one term there are a few rows for each map task.

The empty term stands for the record itself: its counts are those of the records that hold any term.

Defined results: null, empty and wordless texts and null record ids hold no terms; repeated rows count once; a record of several different texts has the
terms of all of them; a very long text is one row that is split whole; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurus.operators.resources import small
from lurus.plans.session import checkpointed, scratch, staged

BITS = 6
#: Rows that a task holds while it adds up.
COMBINED = 500_000
COUNTS = "field_name string, term string, n_records long, n_occurrences long"


def terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1)), F.lower)


def partial_counts(texts: DataFrame) -> DataFrame:
    """(field_name, term, n_records, n_occurrences) of (field_name, record, text), added up within tasks only.

    Nearly all records have one text, whose different terms are its record's. Only records of several texts have theirs brought together, by term, so
    that a record which holds a third of all rows is spread over its terms. The texts are read and made distinct once.
    """
    rows = staged(texts.where("record is not null and text is not null").distinct(), "texts")
    several = rows.groupBy("field_name", "record").agg(F.count("*").alias("texts")).where("texts > 1").select("field_name", "record", F.lit(True).alias("several"))
    flagged = rows.join(small(checkpointed(several)), ["field_name", "record"], "left").select("field_name", "record", "several", terms(F.col("text")).alias("ts")).where(F.size("ts") > 0)
    # each occurrence of a term, and once each different term where the text is the record's only one
    count = lambda r, o: lambda t: F.struct(t.alias("term"), F.lit(r).cast("long").alias("n_records"), F.lit(o).cast("long").alias("n_occurrences"))
    both = F.concat(F.array(count(1, 0)(F.lit(""))), F.transform(F.array_distinct("ts"), count(1, 0)), F.transform("ts", count(0, 1)))
    alone = flagged.where("several is null").select("field_name", F.explode(both).alias("t")).select("field_name", "t.*")
    with_record = F.concat(F.array(F.lit("")), F.col("ts"))
    shared = flagged.where("several").select("field_name", "record", F.explode(with_record).alias("term")).groupBy("field_name", "record", "term").agg(F.count("*").alias("n_occurrences")).select("field_name", "term", F.lit(1).cast("long").alias("n_records"), "n_occurrences")
    return alone.union(shared).mapInArrow(combine, COUNTS)


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up a task's counts, a bounded number of rows at a time."""
    held, rows = [], 0
    for batch in _ended(batches):
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
        if held and (batch is None or rows >= COMBINED):
            got = pa.Table.from_batches(held).group_by(["field_name", "term"]).aggregate([("n_records", "sum"), ("n_occurrences", "sum")])
            held, rows = [], 0
            yield from got.select(["field_name", "term", "n_records_sum", "n_occurrences_sum"]).rename_columns(["field_name", "term", "n_records", "n_occurrences"]).combine_chunks().to_batches(50_000)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


FIELDS = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("n_records", pa.int64()), ("n_occurrences", pa.int64())])


def aggregate_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (folder): the sums of each folder's partial counts, by DuckDB, which spills beyond its share of memory."""
    import duckdb
    import pyarrow.dataset as ds
    from pyarrow import fs

    config = {"threads": "1", "memory_limit": "400MB", "preserve_insertion_order": "false"}
    spill = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]  # Spark's own spill folder, never one of ours
    with duckdb.connect(config=config | ({"temp_directory": spill} if spill else {})) as db:
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            files, path = fs.FileSystem.from_uri(folder)
            source = ds.dataset(path, schema=FIELDS, filesystem=files, format="parquet").scanner(batch_size=50_000, batch_readahead=1, fragment_readahead=1).to_reader()
            db.register("partial_counts", source)
            out = db.sql("SELECT field_name, term, sum(n_records)::BIGINT AS n_records, sum(n_occurrences)::BIGINT AS n_occurrences FROM partial_counts GROUP BY ALL")
            for batch in out.to_arrow_reader(50_000):
                yield pa.RecordBatch.from_arrays([batch.column(i).cast(t) for i, t in enumerate(FIELDS.types)], schema=FIELDS)
            db.unregister("partial_counts")


def spill(rows: DataFrame, depth: int, bits: int, path: str) -> list[tuple[int, int]]:
    """Writes rows with their hash h to a folder for each value of the depth-th `bits` bits of it; gives the values and their rows."""
    prefix = F.shiftrightunsigned("h", 64 - depth * bits).bitwiseAND(F.lit((1 << bits) - 1))
    named = rows.withColumn("p", prefix)
    named.repartition(F.col("p")).write.option("compression", "zstd").partitionBy("p").parquet(path)
    written = rows.sparkSession.read.schema("h long, p long").parquet(path)
    return [(r.p, r.n) for r in written.groupBy("p").agg(F.count("*").alias("n")).collect()]  # 2 ** bits rows at most, from the files' own counts


def radix_leaves(rows: DataFrame, limit: int, bits: int = BITS) -> list[str]:
    """Folders of rows that are equal in the highest bits of their hash, none of more than `limit` rows unless the hash has no more bits."""
    spark = rows.sparkSession
    schema = rows.schema
    leaves: list[str] = []
    waiting = [(rows, 1)]
    while waiting:
        part, depth = waiting.pop()
        path = scratch(spark, "radix")
        for p, n in spill(part, depth, bits, path):
            folder = f"{path}/p={p}"
            if n > limit and (depth + 1) * bits <= 60:
                waiting.append((spark.read.schema(schema).parquet(folder), depth + 1))
            else:
                leaves.append(folder)
    return leaves


def counts(texts: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """(field_name, term, n_records, n_occurrences) of (field_name, record, text); the row of the empty term counts the records that hold any."""
    spark = texts.sparkSession
    partial = partial_counts(texts).withColumn("h", F.xxhash64("field_name", "term"))
    leaves = radix_leaves(partial, limit)
    tasks = max(1, min(len(leaves), 4 * spark.sparkContext.defaultParallelism, 100_000) if leaves else 1)
    folders = spark.createDataFrame([(f,) for f in leaves], "folder string")
    return folders.repartition(tasks).mapInArrow(aggregate_leaves, COUNTS)


def count_terms(texts: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """The same of the terms alone."""
    return counts(texts, limit).where("term <> ''")


def marked(texts: DataFrame, rare: int = 1, common: float = 0.1, limit: int = 2_000_000) -> DataFrame:
    """Adds records and mark: `rare` for a term in at most `rare` records, else `common` for one in more than that share of the records of its field that
    hold any term."""
    all_ = checkpointed(counts(texts, limit))
    records = F.broadcast(all_.where("term = ''").select("field_name", F.col("n_records").alias("records")))  # a row for each field
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > common * F.col("records"), "common")
    return all_.where("term <> ''").join(records, "field_name").withColumn("mark", mark)
