"""Sinks. All overwrite or append idempotently by directory; resuming rewrites a partition instead of appending rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurus.plans.session import importable

TEXT = {"quote": '"', "escape": '"', "header": True, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").options(**TEXT, sep=sep).csv(path)


def run(df: DataFrame, path: str, run_id: str) -> None:
    """Append a run's results: its own partition, written whole, so that a repeated run replaces itself."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def run_csv(df: DataFrame, path: str, run_id: str, sep: str = ",") -> None:
    """The same as CSV: a folder `run_id=<run>` of files with one header each, the columns in a fixed order; a repeated run replaces itself, other runs stay."""
    df.write.mode("overwrite").options(**TEXT, sep=sep).csv(f"{path}/run_id={run_id}")


def resumed(df: DataFrame, path: str, id_col: str, write) -> int:
    """Goes on with an interrupted job: only rows whose id the parquet folder lacks are made (write: frame -> frame) and added; gives the number that was there."""
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    there = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(f"{path}/_SUCCESS"))
    done = spark.read.parquet(path).select(id_col).distinct() if there else df.select(id_col).limit(0)
    before = done.count()
    write(df.join(done, id_col, "left_anti")).write.mode("append").parquet(path)
    return before


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def parallel(df: DataFrame, by: str, src: str, tgt: str, path: str) -> None:
    """`<path>.src` and `<path>.tgt`, whose n-th lines belong together: both are written from the same range partitions."""
    ordered = df.repartitionByRange(by).sortWithinPartitions(by)
    for column, ending in ((src, "src"), (tgt, "tgt")):
        ordered.select(F.regexp_replace(column, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(f"{path}.{ending}")


def document(df: DataFrame, path: str) -> None:
    """A one-row frame as one JSON object."""
    df.limit(1).select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def files(df: DataFrame, id_col: str, content: str, folder: str, ending: str = "png", digits: int = 9) -> DataFrame:
    """Write bytes to files named by id, in a folder that all executors share; returns (id, name, length). A repeated run writes the same files."""

    def write(batches):
        Path(folder).mkdir(parents=True, exist_ok=True)
        for b in batches:
            names = [f"{i:0{digits}d}.{ending}" for i in b["id"]]
            for name, data in zip(names, b["content"]):
                if data is not None:
                    Path(folder, name).write_bytes(data)
            yield b.assign(name=names, length=[None if x is None else len(x) for x in b["content"]])[["id", "name", "length"]]

    importable(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(content).alias("content")).mapInPandas(write, "id long, name string, length long")


def _few(df: DataFrame, most: int) -> list:
    """All rows of a small result; more than `most` are refused, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    return rows


def report(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A small result as text, with bars for columns named share."""
    rows = _few(df, most)
    lines = [title, "=" * len(title)] + ["  ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in r.asDict().items()) + ("  " + "█" * round(40 * r["share"]) if "share" in df.columns and r["share"] is not None else "") for r in rows]
    return "\n".join(lines) + "\n"


def latex(df: DataFrame, most: int = 10_000) -> str:
    """A small result as the body of a LaTeX table."""
    esc = lambda v: (f"{v:.2f}" if isinstance(v, float) else str(v)).replace("&", r"\&").replace("%", r"\%").replace("_", r"\_")
    return "\n".join(" & ".join(esc(v) for v in r) + r" \\" for r in _few(df, most)) + "\n"
