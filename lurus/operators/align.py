"""Operators that need block matching, which has no relational form: Arrow-batched Python over distinct text pairs."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurus.functions.stats import ratio
from lurus.functions.text import mend_spacing
from lurus.operators.scoring import prf
from lurus.plans.session import checkpointed, spread

EDITS = "array<struct<i:int,j:int,src:string,tgt:string>>"
EVENTS = "array<struct<ch:string,outcome:string>>"


def token_edits(src: str | None, tgt: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, source tokens, target tokens) of each difference between two token sequences."""
    a, b = (src or "").split(), (tgt or "").split()
    return [(i, j, " ".join(a[i:j]), " ".join(b[k:m])) for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if kind != "equal"]


def char_events(true: str | None, seen: str | None) -> list[tuple[str, str]]:
    """(character, outcome) of an alignment of a true and a seen text: `=x` for kept or replaced characters, `DEL`; insertions as ("", x)."""
    a, b, out = true or "", seen or "", []
    for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [(x, "=" + x) for x in a[i:j]]
            continue
        both = min(j - i, m - k) if kind == "replace" else 0
        out += [(a[i + n], "=" + b[k + n]) for n in range(both)]
        out += [(x, "DEL") for x in a[i + both : j]] + [("", x) for x in b[k + both : m]]
    return out


def _over_pairs(function, schema: str):
    @F.pandas_udf(schema)
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x, y) for x, y in zip(a, b)])

    return udf


def edits(src: Column, tgt: Column) -> Column:
    return _over_pairs(token_edits, EDITS)(src, tgt)


def events(true: Column, seen: Column) -> Column:
    return _over_pairs(char_events, EVENTS)(true, seen)


def edit_counts(df: DataFrame, src: str, hyp: str, ref: str, keep: tuple[str, ...] = (), spacing: bool = True) -> DataFrame:
    """tp, fp, fn of the edits from source to hypothesis against those to the reference, in lower case, row by row."""
    form = lambda c: mend_spacing(F.lower(F.coalesce(F.col(c), F.lit("")))) if spacing else F.lower(F.coalesce(F.col(c), F.lit("")))
    base = df.select(*keep, form(src).alias("s"), form(hyp).alias("h"), form(ref).alias("r"))
    rows = spread(base).select(*keep, edits(F.col("s"), F.col("h")).alias("got"), edits(F.col("s"), F.col("r")).alias("want"))
    both = F.size(F.array_intersect("got", "want"))
    return rows.select(*keep, both.alias("tp"), F.size(F.array_except("got", "want")).alias("fp"), F.size(F.array_except("want", "got")).alias("fn"))


def edit_sums(df: DataFrame, src: str, hyp: str, ref: str, keep: tuple[str, ...] = (), spacing: bool = True) -> DataFrame:
    """The same summed over rows that are equal in the kept columns and the three texts, each of which is aligned once."""
    rows = df.groupBy(*keep, src, hyp, ref).agg(F.count("*").alias("times"))
    counted = edit_counts(rows, src, hyp, ref, (*keep, "times"), spacing)
    return counted.select(*keep, *((F.col(c) * F.col("times")).alias(c) for c in ("tp", "fp", "fn")))


def edit_prf(counts: DataFrame) -> DataFrame:
    return counts.agg(*prf(F.sum("tp"), F.sum("fp"), F.sum("fn")))


def channel(df: DataFrame, true: str, seen: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ch, outcome, n) of substitutions and deletions, (ch, n) of insertions, and one row with n_pairs and ins_rate."""
    pairs = df.where(F.col(true).isNotNull() & F.col(seen).isNotNull()).groupBy(true, seen).agg(F.count("*").alias("times"))  # equal pairs are aligned once
    rows = spread(pairs).select(true, "times", events(F.col(true), F.col(seen)).alias("e"))
    rows = checkpointed(rows)  # three results rest on one alignment
    counts = rows.select("times", F.explode("e").alias("e")).groupBy("e.ch", "e.outcome").agg(F.sum("times").alias("n"))
    inserted, letters = F.size(F.filter("e", lambda x: x["ch"] == "")), F.greatest(F.length(true), F.lit(1))
    rate = rows.agg(F.sum("times").alias("n_pairs"), ratio(F.sum(inserted * F.col("times")).cast("double"), F.sum(letters * F.col("times")).cast("double")).alias("ins_rate"))
    return counts.where("ch <> ''"), counts.where("ch = ''").select(F.col("outcome").alias("ch"), "n"), rate


def common_insertions(insertions: DataFrame, top: int = 40) -> DataFrame:
    """(ch, n) of the symbols most often inserted."""
    return insertions.orderBy(F.col("n").desc(), "ch").limit(top)


def error_prone(counts: DataFrame, least: int = 20, top: int = 15, others: int = 3) -> DataFrame:
    """(ch, total, error_rate, alternatives): the characters most often misread, those seen at least `least` times."""
    wrong = F.col("outcome") != F.concat(F.lit("="), F.col("ch"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy("ch", wrong).orderBy(F.col("n").desc(), "outcome")))
    alternatives = F.transform(F.sort_array(F.collect_list(F.when(wrong & (F.col("_r") <= others), F.struct("_r", "outcome")))), lambda x: x["outcome"])
    rows = ranked.groupBy("ch").agg(F.sum("n").alias("total"), ratio(F.sum(F.when(wrong, F.col("n")).otherwise(0)).cast("double"), F.sum("n").cast("double")).alias("error_rate"), alternatives.alias("alternatives"))
    return rows.where(F.col("total") >= least).orderBy(F.col("error_rate").desc(), "ch").limit(top)


def greedy_pieces(vocabulary: frozenset[str], unknown: str = "[UNK]", longest: int | None = None):
    """A column function: words cut into the longest pieces that a supplied vocabulary has, `##` before those inside a word. Pieces of any length are
    matched, unless a longest one is given."""
    longest = longest or max(map(len, vocabulary), default=1)

    def cut(word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            for end in range(min(len(word), at + longest), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in vocabulary:
                    out.append(piece)
                    at = end
                    break
            else:
                return [unknown]
        return out

    @F.pandas_udf("string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else " ".join(p for w in t.split() for p in cut(w)) for t in batch])

    return udf
