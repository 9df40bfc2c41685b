"""Preparation of training pairs: tags, vocabularies, ids, padding, out-of-vocabulary checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurus.functions.text import squeeze, tokens
from lurus.operators.resources import small

#: Special tokens in the order of their ids, and the tag of each category code and name.
SPECIAL = ("<pad>", "<unk>", "<s>", "</s>")
PAD, UNK, BOS, EOS = range(4)
TAGS = {"ALG": "<semantic>", "SEM": "<semantic>", "SIN": "<syntactic>", "EJA": "<morphological>", "MOR": "<morphological>", "TIP": "<morphological>", "MIX": "<morphological>", "ALGOSPEAK": "<semantic>", "SEMANTIC": "<semantic>", "SYNTACTIC": "<syntactic>", "SPELLING": "<morphological>", "MORPHOLOGICAL": "<morphological>", "TYPOGRAPHIC": "<morphological>", "MIXED": "<morphological>"}
DEFAULT_TAG = "<morphological>"
#: The group of each grammar category of the source corpus.
GROUPS = {
    "afiksasi": "morphological", "pembentukan_kata": "morphological", "reduplikasi": "morphological", "sintaksis_frasa": "syntactic", "preposisi": "syntactic", "kelengkapan_kalimat": "syntactic",
    "diksi": "semantic", "ambigu": "semantic", "pleonasme": "semantic", "pleonasme_claude": "semantic", "diksi_claude": "semantic", "ambigu_claude": "semantic",
}


def mapped(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, value), F.lit(default))


def tag(category: Column) -> Column:
    """The model's tag of a category given by name or code."""
    code = F.upper(squeeze(F.coalesce(category, F.lit(""))))
    return mapped(code, TAGS, DEFAULT_TAG)


def grammar_group(category: Column) -> Column:
    return mapped(F.lower(squeeze(category)), GROUPS)


def with_tag(text: Column, tag_: Column) -> Column:
    return F.concat(tag_, F.lit(" "), text)


def tag_of(text: Column) -> Column:
    """The tag name at a text's start, null without one."""
    return F.nullif(F.regexp_extract(text, r"^<([^>]+)>\s*", 1), F.lit(""))


def without_tag(text: Column) -> Column:
    return F.regexp_replace(text, r"^<[^>]+>\s*", "")


def majority(values: Column, fallback: Column) -> Column:
    """The most frequent value of an array, the first to occur among equals; the fallback if it has none."""
    named = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    scored = F.transform(F.array_distinct(named), lambda v: F.struct(F.size(F.filter(named, lambda x: x == v)).alias("n"), (-F.array_position(named, v)).alias("first"), v.alias("v")))
    return F.coalesce(F.array_max(scored)["v"], fallback)


def in_split(split: Column, name: str) -> Column:
    """Whether a row is of a split; `val` may be spelled `valid`."""
    bare = F.lower(squeeze(split))
    return F.coalesce(bare.isin("val", "valid", "validation") if name == "val" else bare == name, F.lit(False))


def with_hypotheses(rows: DataFrame, id_col: str, source: str, hyps: DataFrame) -> DataFrame:
    """Adds hyp and gec_score from (id, hyp, gec_score); a row without a hypothesis keeps its source and has no score."""
    joined = rows.join(hyps.select(F.col("id").alias(id_col), "hyp", "gec_score"), id_col, "left")
    return joined.withColumn("hyp", F.coalesce("hyp", F.col(source)))


def tag_inventory(df: DataFrame, split: str, text: str, id_col: str, samples: int = 3) -> DataFrame:
    """(split, tag, n, samples): the tags that texts start with, `untagged` for none, and the texts of the lowest ids. No group is gathered: the samples
    are the least of bounded aggregates."""
    rows = df.select(F.col(split).alias("split"), F.coalesce(tag_of(F.col(text)), F.lit("untagged")).alias("tag"), F.col(id_col).alias("i"), F.col(text).alias("t"))
    w = Window.partitionBy("split", "tag").orderBy("i")
    few = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= samples).groupBy("split", "tag").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]).alias("samples"))
    counts = rows.groupBy("split", "tag").agg(F.count("*").alias("n"))
    same = F.col("c.split").eqNullSafe(F.col("f.split")) & (F.col("c.tag") == F.col("f.tag"))
    return counts.alias("c").join(few.alias("f"), same).select("c.split", "c.tag", "n", "samples")


def chosen_source(alternative: Column, source: Column) -> Column:
    """The alternative where it has text, else the source."""
    return F.coalesce(F.when(squeeze(alternative) != "", alternative), source)


def vocabulary(df: DataFrame, *texts: str, least: int = 1) -> DataFrame:
    """(token, n, token_id): ids by descending frequency, then by token, after the special tokens.

    Numbering needs one order over all tokens; it is taken over distinct tokens, range-partitioned, never over occurrences.
    """
    from lurus.plans.indexing import row_index

    words = None
    for c in texts:
        part = df.select(F.explode(tokens(F.col(c), lower=True)).alias("token"))
        words = part if words is None else words.unionAll(part)
    counts = words.groupBy("token").agg(F.count("*").alias("n")).where((F.col("n") >= least) & ~F.col("token").isin(*SPECIAL)).withColumn("_down", -F.col("n"))
    return row_index(counts, "_down", "token").select("token", "n", (F.col("i") + len(SPECIAL)).alias("token_id"))


def encode(df: DataFrame, id_col: str, text: str, vocab: DataFrame, bos: bool = False, eos: bool = True, most: int | None = None) -> DataFrame:
    """(id, ids) for unique ids: unknown tokens as <unk>, cut so that marks fit."""
    base = df.select(F.col(id_col).alias("id"), tokens(F.col(text), lower=True).alias("ts"))
    if most:
        base = base.withColumn("ts", F.slice("ts", 1, max(0, most - bos - eos)))
    flat = base.select("id", F.posexplode_outer("ts").alias("pos", "token")).join(small(vocab.select("token", "token_id")), "token", "left")
    got = flat.groupBy("id").agg(F.sort_array(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(UNK)).alias("t"))))).alias("p"))
    ids = F.transform("p", lambda p: p["t"].cast("long"))
    mark = lambda on, x: F.array(F.lit(x).cast("long")) if on else F.array().cast("array<bigint>")
    return got.select("id", F.concat(mark(bos, BOS), ids, mark(eos, EOS)).alias("ids"))


def decode(df: DataFrame, id_col: str, ids: str, vocab: DataFrame) -> DataFrame:
    """(id, text): tokens of the ids joined by blanks; special and unknown ids are skipped."""
    flat = df.select(F.col(id_col).alias("id"), F.posexplode_outer(ids).alias("pos", "token_id")).join(small(vocab.select("token", "token_id")), "token_id", "left")
    token = F.when(F.col("token_id") >= len(SPECIAL), F.col("token"))
    return flat.groupBy("id").agg(F.sort_array(F.collect_list(F.when(token.isNotNull(), F.struct("pos", token.alias("t"))))).alias("p")).select("id", F.array_join(F.transform("p", lambda p: p["t"]), " ").alias("text"))


def padded(df: DataFrame, ids: str, batch: str) -> DataFrame:
    """Adds padded and mask: ids filled up to the longest of their batch."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    fill = longest - F.size(ids)
    return df.withColumn("padded", F.concat(F.col(ids), F.array_repeat(F.lit(PAD).cast("long"), fill))).withColumn("mask", F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), fill)))


def unknown_tokens(df: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """(token, n) of tokens that the list of known ones lacks. Tokens are counted before the join."""
    counts = df.select(F.explode(tokens(F.col(text), lower=True)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.join(small(known.select("token").distinct()), "token", "left_anti")


def unknown_rate(df: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """One row: n tokens, how many of them the list of known ones lacks, and their rate."""
    counts = df.select(F.explode(tokens(F.col(text), lower=True)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rows = counts.join(small(known.select("token", F.lit(True).alias("known")).distinct()), "token", "left")
    unknown = F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0))
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), unknown.alias("unknown")).withColumn("rate", F.coalesce(F.try_divide("unknown", "n"), F.lit(0.0)))


def in_categories(df: DataFrame, category: str, wanted: tuple[str, ...]) -> DataFrame:
    """Rows of the wanted categories."""
    return df.where(F.col(category).isin(*wanted))


def code3(category: Column) -> Column:
    return F.upper(F.substring(category, 1, 3))


def stem_key(path: Column, part: Column) -> Column:
    """`<file name without folder and ending>_<part>`."""
    return F.concat_ws("_", F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1), part)
