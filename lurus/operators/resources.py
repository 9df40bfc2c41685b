"""Word lists and rule tables that the normaliser rests on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurus.functions.text import core, squeeze, tokens

LEAST_FREQUENCY, LEAST_LENGTH = 2, 2
#: Tables that normalisation looks words up in are broadcast up to so many rows and bytes; beyond, they are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def small(df: DataFrame) -> DataFrame:
    """The frame, marked for broadcast if a look at one row more than the bound shows that it is small in rows and bytes. What the planner itself expects
    to be small enough is left to it, without a look."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return df
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if kind == "string" else F.octet_length(F.to_json(F.array(c))) if kind.startswith(("array", "map", "struct")) else F.lit(8) for c, kind in df.dtypes), start=F.lit(8))
    n, size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def lexicon(words: DataFrame, word: str = "w", freq: str = "f") -> DataFrame:
    """(w, f): alphabetic words of two or more letters and uses, in lower case, each with its highest frequency."""
    w = F.lower(squeeze(F.col(word)))
    rows = words.select(w.alias("w"), F.col(freq).cast("long").alias("f")).where(F.col("w").rlike(r"^\p{L}+$"))
    return rows.where((F.length("w") >= LEAST_LENGTH) & (F.col("f") >= LEAST_FREQUENCY)).groupBy("w").agg(F.max("f").alias("f"))


def augmented(base: DataFrame, texts: DataFrame, text: str, freq: int = LEAST_FREQUENCY) -> DataFrame:
    """The lexicon with the words of trusted texts added; words it has keep their frequency."""
    words = texts.select(F.explode(tokens(F.col(text), lower=True)).alias("t")).select(core(F.col("t")).alias("w"))
    words = words.where(F.col("w").rlike(r"^\p{L}+$") & (F.length("w") >= LEAST_LENGTH)).distinct().withColumn("f", F.lit(freq).cast("long"))
    rows = base.withColumn("o", F.lit(0)).unionByName(words.withColumn("o", F.lit(1)))
    return rows.groupBy("w").agg(F.min_by("f", "o").alias("f"))


def lookup(rules: DataFrame, formal: str = "formal", variant: str = "variant") -> DataFrame:
    """(variant, target): variants of two or more characters without a blank that stand for one formal word alone."""
    rows = rules.select(F.lower(squeeze(F.col(variant))).alias("variant"), F.lower(squeeze(F.col(formal))).alias("target"))
    rows = rows.where((F.length("variant") >= 2) & ~F.contains(F.col("variant"), F.lit(" ")) & (F.col("target") != ""))
    return rows.groupBy("variant").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").select("variant", "target")


def injection_rules(rules: DataFrame) -> DataFrame:
    """(formal, variants): what a formal word may be replaced by, in order."""
    rows = rules.select(F.lower(squeeze(F.col("formal"))).alias("formal"), squeeze(F.col("variant")).alias("variant")).where("formal <> '' and variant <> ''")
    return rows.groupBy("formal").agg(F.sort_array(F.collect_set("variant")).alias("variants"))
