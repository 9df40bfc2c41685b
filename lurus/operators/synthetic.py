"""Synthetic pairs: a damaged text for each clean one, by category and budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurus.operators import corrupt, dataset, sampling
from lurus.operators.quality import identical

#: What each kind of damage is made with; other categories keep the source they have.
SPELLING, TYPING, SLANG = "spelling", "typographic", "algospeak"


def damaged_pairs(clean: DataFrame, id_col: str, text: str, category: str, rules: DataFrame, seed: int = 42) -> DataFrame:
    """(id, category, src, trg): each clean text damaged as its category says. Rows are routed once; every branch reads only its own."""
    rows = clean.select(F.col(id_col).alias("id"), F.col(category).alias("category"), F.col(text).alias("trg"))
    of = lambda c: rows.where(F.col("category") == c)
    damage = (
        corrupt.inject_spelling(of(SPELLING), "id", "trg", "spelling", seed=seed)
        .unionByName(corrupt.inject_spelling(of(TYPING), "id", "trg", "typographic", seed=seed))
        .unionByName(corrupt.inject_slang(of(SLANG), "id", "trg", rules, seed=seed))
    )
    return rows.join(damage.withColumnRenamed("damaged", "src"), "id").select("id", "category", "src", "trg")


def generated(pairs: DataFrame, weights: DataFrame, total: int, rules: DataFrame, seed: int = 42) -> DataFrame:
    """(id, category, src, trg, split): a training corpus by category weights from clean texts (id, category, src, trg). Each category takes its budget of
    rows in hashed order; damaged categories get their errors, the others keep the source they came with; pairs that stayed equal are left out."""
    budgets = sampling.budget(weights, "category", "weight", total)
    texts = pairs.where(F.col("trg").isNotNull())
    drawn = sampling.take_budget(texts, "category", budgets, "id", F.lit(True), seed)
    made = damaged_pairs(drawn, "id", "trg", "category", rules, seed)
    kept = drawn.where(~F.col("category").isin(SPELLING, TYPING, SLANG)).select("id", "category", "src", "trg")
    rows = made.unionByName(kept)
    return rows.where(~identical("src", "trg")).withColumn("split", F.lit("train"))


def held_out(clean: DataFrame, used: DataFrame, used_text: str, weights: DataFrame, total: int, rules: DataFrame, seed: int = 42) -> DataFrame:
    """(id, tag, category, src, trg): a test set of clean texts (id, category, trg) that no used text equals, one row for each text key, damaged by
    category, by rounded budgets, rows that damage left unchanged being passed over."""
    fresh = sampling.first_of_key(sampling.unused(clean.where(F.col("trg").isNotNull()), "trg", used, used_text), "trg", "id", seed)
    pairs = damaged_pairs(fresh, "id", "trg", "category", rules, seed)
    budgets = sampling.budget(weights, "category", "weight", total, remainder_to_first=False)
    rows = sampling.take_budget(pairs, "category", budgets, "id", ~identical("src", "trg"), seed)
    return rows.select("id", dataset.tag(F.col("category")).alias("tag"), dataset.code3(F.col("category")).alias("category"), "src", "trg")
