"""Layered text quality: one narrow table of counters for each row, from which every metric is arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurus.functions import text as T
from lurus.functions.stats import f_beta, ratio


def facts(df: DataFrame, systems: dict[str, str], ref: str, mode: str, keep: Sequence[str] = ()) -> DataFrame:
    """Kept columns, r_len, r_words, and for each system its c_<name> and w_<name>: character and word edits against the reference, and x_<name>: equality.

    Texts are normalised once and each pair is aligned once; nothing downstream reads a text again.
    """
    base = df.select(*keep, T.normal(F.col(ref), mode).alias("_r"), *(T.normal(F.col(c), mode).alias(f"_{n}") for n, c in systems.items()))
    out = [F.length("_r").alias("r_len"), F.size(T.tokens(F.col("_r"))).alias("r_words")]
    for n in systems:
        h = F.col(f"_{n}")
        out += [T.char_edits(h, F.col("_r")).alias(f"c_{n}"), T.word_edits(h, F.col("_r")).alias(f"w_{n}"), (h == F.col("_r")).cast("int").alias(f"x_{n}")]
    counted = base.select(*keep, *out)
    return counted.select("*", *((F.col(f"c_{n}") / F.greatest("r_len", F.lit(1))).alias(f"cer_{n}") for n in systems))


def with_total(df: DataFrame, group: str, *metrics: Column) -> DataFrame:
    """Metrics for each group and for all rows. `is_total` marks the total, so that a group of any name stays itself."""
    return df.groupingSets([[F.col(group)], []], F.col(group)).agg(F.grouping(group).cast("int").alias("is_total"), *metrics)


def micro(edits: str, length: str) -> Column:
    return ratio(F.sum(edits).cast("double"), F.sum(length).cast("double"))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp).alias("p"), ratio(tp, tp + fn).alias("r"), f_beta(tp, fp, fn, 1.0).alias("f1"), f_beta(tp, fp, fn, 0.5).alias("f05")]


def token_counts(src: Column, hyp: Column, ref: Column) -> Column:
    """tp, fp, fn of token-level normalisation: tokens are paired by place, the shorter side padded with ''. A wrong change of a token that needed one
    counts as missed only."""
    s, h, r = T.tokens(src), T.tokens(hyp), T.tokens(ref)
    three = F.arrays_zip(s.alias("s"), h.alias("h"), r.alias("r"))
    pad = lambda c: F.coalesce(c, F.lit(""))

    def one(x: Column) -> Column:
        a, b, c = pad(x["s"]), pad(x["h"]), pad(x["r"])
        return F.when((a != c) & (b == c), "tp").when(a != c, "fn").when((b != a) & (b != c), "fp")

    kinds = F.transform(three, one)
    count = lambda k: F.size(F.filter(kinds, lambda x: x == k))
    return F.struct(*(count(k).alias(k) for k in ("tp", "fp", "fn")))


def scope_tokens(sentences: DataFrame, scope: str) -> DataFrame:
    """(id, pos, low, gold, clean) of (id, text, errors): each token's core; its target if it is a single-token error of the scope (the last of repeated
    ones), and whether it stands in no error at all."""
    strip = lambda t: F.lower(T.core(T.squeeze(t)))
    single = F.filter("errors", lambda e: (F.upper(T.squeeze(e["category"])) == scope) & (F.size(T.tokens(e["token_salah"])) == 1) & (T.squeeze(F.coalesce(e["token_benar"], F.lit(""))) != ""))
    pairs = F.transform(single, lambda e: F.struct(strip(e["token_salah"]).alias("k"), strip(e["token_benar"]).alias("v")))
    wrong = F.flatten(F.transform("errors", lambda e: F.transform(T.tokens(e["token_salah"]), strip)))
    base = sentences.select("id", T.tokens(F.col("text")).alias("ts"), F.reverse(F.coalesce(pairs, F.array().cast("array<struct<k:string,v:string>>"))).alias("gold"), F.coalesce(wrong, F.array().cast("array<string>")).alias("wrong"))
    flat = base.select("id", F.posexplode("ts").alias("pos", "t"), "gold", "wrong").withColumn("low", strip(F.col("t")))
    target = F.get(F.filter("gold", lambda g: g["k"] == F.col("low")), F.lit(0))["v"]
    return flat.where("low <> ''").select("id", "pos", "low", target.alias("gold"), (~F.array_contains("wrong", F.col("low"))).alias("clean"))


def scope_counts(scope: DataFrame, changes: DataFrame) -> DataFrame:
    """Of scope tokens and changes (low, out[, *group]): tp, fp, fn. Wrong changes count as false only on clean tokens."""
    rows = scope.join(changes, "low", "left").withColumn("to", F.coalesce("out", "low"))
    hit = F.col("gold").isNotNull()
    return rows.agg(*prf(F.count_if(hit & (F.col("to") == F.col("gold"))), F.count_if(~hit & F.col("clean") & (F.col("to") != F.col("low"))), F.count_if(hit & (F.col("to") != F.col("gold")))))


def scope_runs(scope: DataFrame, changes: DataFrame, run: str, *more: str) -> DataFrame:
    """The same for each of several runs: scope tokens (run, *more, low, gold, clean) and changes (run, low, out). Equal tokens are added up before the join."""
    tokens_ = scope.groupBy(run, *more, "low", "gold", "clean").agg(F.count("*").alias("times"))
    rows = tokens_.join(changes.select(run, "low", "out"), [run, "low"], "left").withColumn("to", F.coalesce("out", "low"))
    hit, times = F.col("gold").isNotNull(), F.col("times")
    total = lambda c: F.coalesce(F.sum(F.when(c, times)), F.lit(0))
    return rows.groupBy(run, *more).agg(*prf(total(hit & (F.col("to") == F.col("gold"))), total(~hit & F.col("clean") & (F.col("to") != F.col("low"))), total(hit & (F.col("to") != F.col("gold")))))


def scope_report(scope: DataFrame, changes: DataFrame, limit: int = 20) -> DataFrame:
    """(id, pos, low, predicted, gold, hit) of the first tokens that have a target."""
    rows = scope.where("gold is not null").join(changes.select("low", "out"), "low", "left").withColumn("predicted", F.coalesce("out", "low"))
    return rows.select("id", "pos", "low", "predicted", "gold", (F.col("predicted") == F.col("gold")).alias("hit")).orderBy("id", "pos").limit(limit)


def token_function_counts(scope: DataFrame, function) -> DataFrame:
    """tp, fp, fn of any Python function from token to token, called once for each distinct core, in Arrow batches."""

    @F.pandas_udf("string")
    def udf(cores):
        return cores.map(function)

    low = scope.select("low").distinct()
    return scope_counts(scope, low.select("low", udf("low").alias("out")).where("out <> low"))


#: The main metric of each layer, and how its counters are made and summed.
PRIMARY = {"L1": "CER", "L2": "F0.5", "L3": "F0.5", "E2E": "CER"}


def layer_metrics(layer: str) -> dict[str, Column]:
    """Named metrics of a layer over its counters: edits (c_hyp, r_len, w_hyp, r_words) for L1 and E2E, tp, fp, fn for L2 and L3."""
    if layer not in PRIMARY:
        raise ValueError(f"layer is one of {tuple(PRIMARY)}")
    if PRIMARY[layer] == "CER":
        return {"CER": micro("c_hyp", "r_len"), "WER": micro("w_hyp", "r_words")}
    tp, fp, fn = (F.coalesce(F.sum(c), F.lit(0)) for c in ("tp", "fp", "fn"))
    return dict(zip(("tp", "fp", "fn", "P", "R", "F1", "F0.5"), prf(tp, fp, fn)))


def evaluated(counters: DataFrame, layer: str, group: str = "category") -> DataFrame:
    """(category, n, *metrics of the layer, primary), one row for each category in order and one for ALL, which comes last."""
    metrics = layer_metrics(layer)
    rows = with_total(counters, group, F.count("*").alias("n"), *(c.alias(k) for k, c in metrics.items()))
    named = rows.select(F.when(F.col("is_total") == 1, "ALL").otherwise(F.col(group)).alias(group), "is_total", "n", *(F.col(f"`{k}`") for k in metrics), F.col(f"`{PRIMARY[layer]}`").alias("primary"))
    return named.orderBy("is_total", group).drop("is_total")
