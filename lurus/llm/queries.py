"""Queries of the training-data problems, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurus.llm import abuse, collapse, families, overlap, packing, proportions, terms, tokens
from lurus.llm.oracle import SQL
from lurus.llm.text import split_name
from lurus.plans.session import table

TEXTS = ("src_text", "trg_text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "sample_targets")
    return proportions.report(proportions.reservoirs(table(spark, sf_dir, "syn_metadata"), targets), targets).where("exhausted").select("split", "category")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "sample_targets")
    return proportions.report(proportions.reservoirs(table(spark, sf_dir, "syn_metadata"), targets), targets).select("split", "category", "n", "available", F.round("wanted", 6).alias("wanted"), "quota", "exhausted")


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proportions.sample(table(spark, sf_dir, "syn_metadata"), table(spark, sf_dir, "sample_targets")).select("split", "category", F.col("id").alias("image_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.families(table(spark, sf_dir, "syn_metadata")).select("family_id", F.col("id").alias("image_id"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.assign_splits(table(spark, sf_dir, "syn_metadata"), table(spark, sf_dir, "split_targets")).select(F.col("id").alias("image_id"), "family_id", "split")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.cross_pairs(table(spark, sf_dir, "syn_metadata"))
    return pairs.select(F.least("id_t", "id_e").alias("image_id_a"), F.greatest("id_t", "id_e").alias("image_id_b"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records of each split and origin that stand in training, exactly or almost, and their mean overlap fraction."""
    df = table(spark, sf_dir, "syn_metadata")
    found = overlap.overlapped(df).withColumnRenamed("id", "image_id")
    held = df.select("image_id", split_name(F.col("split")).alias("split"), "origin").where("split in ('val', 'test')")
    rows = held.join(found, "image_id", "left")
    return rows.groupBy("split", "origin").agg(F.count("*").alias("records"), F.count_if("exact").alias("exact"), F.count_if(~F.col("exact")).alias("near"), F.avg("fraction").alias("mean_fraction"))


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each evaluation record found: how many training texts, and records that hold them, it is linked to."""
    return overlap.links(table(spark, sf_dir, "syn_metadata")).select(F.col("id").alias("image_id"), "near_texts", "near_records")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = collapse.copies(table(spark, sf_dir, "syn_metadata"), "image_id", TEXTS)
    return pairs.select(F.col("kept").alias("kept_image_id"), F.col("copy").alias("copy_image_id"))


def p6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapsed(table(spark, sf_dir, "syn_metadata"), "image_id", TEXTS).select(F.col("id").alias("image_id"), "copies")


def term_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, record, text) of the three fields whose terms are counted."""
    predicted = table(spark, sf_dir, "predictions").select(F.lit("kalimat_koreksi").alias("field_name"), F.col("id").cast("long").alias("record"), F.col("kalimat_koreksi").alias("text"))
    # a record's corrected tokens are one text, a line each: rows are neither blown up nor told apart by token
    of_sentence = lambda s: F.coalesce(F.transform(F.filter(s["errors"], lambda e: e.isNotNull()), lambda e: e["token_benar"]), F.array().cast("array<string>"))
    joined = F.array_join(F.flatten(F.transform(F.filter("sentences", lambda s: s.isNotNull()), of_sentence)), "\n")
    tokens_ = table(spark, sf_dir, "annotations").select("ann_id", joined.alias("t"))
    rules = table(spark, sf_dir, "algospeak_dict").select(F.lit("formal"), F.col("rule_id").cast("long"), "formal")
    return predicted.union(tokens_.select(F.lit("token_benar"), F.col("ann_id").cast("long"), "t")).union(rules)


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.marked(term_texts(spark, sf_dir)).select("field_name", "term", "n_records", "n_occurrences", "mark")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_terms(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "ids")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents and how many of them their decoded ids give back."""
    docs = table(spark, sf_dir, "documents")
    back = tokens.decode(tokens.encode(docs)).select(F.col("id").alias("doc_id"), F.col("text").alias("back"))
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("back")
    return docs.join(back, "doc_id").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(same).alias("same"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_items(tokens.encode(table(spark, sf_dir, "documents")).select(F.col("id").alias("item"), F.size("ids").alias("size")))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select(F.col("item").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), F.col("bin").alias("container"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).where("piece > 0").select(F.col("item").alias("doc_id")).distinct()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens in them and the share of room used, and the containers that the tokens need at least."""
    bins = packed(spark, sf_dir).where("bin is not null").groupBy("bin").agg(F.sum("size").alias("fill"))
    least = F.ceil(F.sum("fill") / packing.CAPACITY)
    return bins.agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), least.alias("containers_at_least"), (F.sum("fill") / (F.count("*") * packing.CAPACITY)).alias("used"), F.max("fill").alias("fullest"))


def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return abuse.scores(docs, abuse.fit(spark, abuse.labelled(docs, table(spark, sf_dir, "doc_labels"))))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(spark, sf_dir)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(spark, sf_dir).where("found").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(toxic_scores(spark, sf_dir), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("found").alias("found"), F.avg(F.col("found").cast("int")).alias("rate"))


__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_report, p2_sample, p3_found, p3_splits, p4_found, p4_terms, p5_found, p5_report, p5_links, p6_found, p6_collapsed, p7_ids, p7_round_trip, p8_found, p8_containers, p8_report, p9_found, p9_scores, p9_rates)}
