"""The never-guess normaliser: every change must be borne out by a rule or by the lexicon.

Decisions are made once for each distinct core. A core is looked up first; one that the lexicon knows and that has no sign of disguise stays; one with a
digit or mark used as a letter, a star or a `v` is decoded. Decoding does not multiply spellings out: both sides are mapped to a skeleton in which
letters that the same sign may stand for are one, joined on it, and each position is then checked. Only stars are filled in before, at most two, as the
number of spellings may not pass 4,000.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurus.functions.text import has_letter, punct_parts, tokens
from lurus.plans.session import checkpointed

#: What a sign may stand for, in order of preference.
OPTIONS = {"4": "a", "@": "a", "3": "e", "0": "o", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g", "2": "z", "1": "il", "!": "i", "v": "vu"}
LEET = "".join(k for k in OPTIONS if k != "v")
STAR = "abcdefghijklmnopqrstuvwxyz"
MOST = 4000


@dataclass(frozen=True)
class Parts:
    """Which components are on."""

    lookup: bool = True
    leet: bool = True
    censor: bool = True


def skeleton(word: Column) -> Column:
    """One form for all spellings that may stand for each other."""
    return F.translate(word, "4@305$78921!lv", "aaeosstbgziiiu")


def _fits(disguised: Column, word: Column) -> Column:
    """Whether each character of a word is what the one of the disguised core at its place may stand for."""
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    ok = lambda d, w: F.when(d == "1", w.isin("i", "l")).when(d == "v", w.isin("u", "v")).otherwise(F.translate(d, LEET, "".join(OPTIONS[k][0] for k in LEET)) == w)
    return F.forall(F.zip_with(chars(disguised), chars(word), ok), lambda x: x)


def _order(disguised: Column, word: Column) -> Column:
    """Sorts words that fit alike in the order in which the options are tried: only `v` before `u` is not the alphabet's."""
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    return F.array_join(F.zip_with(chars(disguised), chars(word), lambda d, w: F.when((d == "v") & (w == "v"), "a").when((d == "v") & (w == "u"), "b").otherwise(w)), "")


def spellings(core: Column, leet: Column, censor: Column) -> Column:
    """The number of spellings that the options of a core multiply to."""
    count = lambda chars: F.length(core) - F.length(F.translate(core, chars, ""))
    return F.when(leet, F.pow(F.lit(2), count("1v"))).otherwise(F.lit(1)) * F.when(censor, F.pow(F.lit(26), count("*"))).otherwise(F.lit(1))


def decide_all(cores: DataFrame, words: DataFrame, rules: DataFrame, *by: str) -> DataFrame:
    """(*by, low, out, how) of (*by, low, lookup, leet, censor, words_of, rules_of): the cores that change in each of several runs, what to, and by which
    part. A run is a value of the columns `by`; its rows say which parts are on, and by `words_of` and `rules_of` which words (words_of, w, f) and rules
    (rules_of, variant, target) it has. Any number of runs is one plan, in which words and rules stand once."""
    low = cores.where(has_letter(F.col("low"))).distinct()
    known = low.join(words.select("words_of", F.col("w").alias("low"), F.lit(True).alias("valid")), ["words_of", "low"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    known = known.join(rules.select("rules_of", F.col("variant").alias("low"), "target"), ["rules_of", "low"], "left")
    known = known.withColumn("ruled", F.col("target").isNotNull() & ~F.col("valid") & F.col("lookup"))
    signs = F.col("low").rlike(f"[{LEET.replace('$', chr(92) + '$')}*]")
    open_ = (signs | (~F.col("valid") & F.contains(F.col("low"), F.lit("v")))) & (spellings(F.col("low"), F.col("leet"), F.col("censor")) <= MOST)
    known = known.where(F.col("ruled") | open_)
    letters = F.filter(F.split(F.lit(STAR), ""), lambda c: c != "")
    star = lambda f: F.col("censor") & F.contains(f, F.lit("*"))
    one = lambda f: F.when(star(f), F.transform(letters, lambda c: F.regexp_replace(f, r"^([^*]*)\*", F.concat(F.lit("$1"), c)))).otherwise(F.array(f))
    filled = F.flatten(F.transform(one(F.col("low")), one))  # within the bound there are two stars at most
    forms = F.when(~F.col("ruled"), F.filter(filled, lambda f: ~F.contains(f, F.lit("*"))))
    tried = known.select(*by, "low", "ruled", "target", "words_of", "leet", F.explode_outer(forms).alias("form")).withColumn("k", F.when(F.col("leet"), skeleton(F.col("form"))).otherwise(F.col("form")))
    keyed = words.select("words_of", "w", "f", F.explode(F.array(F.struct(F.lit(True).alias("leet"), skeleton(F.col("w")).alias("k")), F.struct(F.lit(False).alias("leet"), F.col("w").alias("k")))).alias("x")).select("words_of", "w", "f", "x.*")
    hits = tried.join(keyed, ["words_of", "leet", "k"], "left")
    fit = (F.length("form") == F.length("w")) & F.when(F.col("leet"), _fits(F.col("form"), F.col("w"))).otherwise(F.col("form") == F.col("w"))
    ranked = F.when(fit, F.struct((-F.col("f")).alias("f"), _order(F.col("low"), F.col("w")).alias("o"), F.col("w").alias("w")))
    best = hits.groupBy(*by, "low", "ruled", "target").agg(F.min(ranked).alias("best"))
    out = F.when(F.col("ruled"), F.col("target")).otherwise(F.col("best")["w"])
    return best.select(*by, "low", out.alias("out"), F.when(F.col("ruled"), "lookup").otherwise("decoded").alias("how")).where(F.col("out").isNotNull() & ((F.col("how") == "lookup") | (F.col("out") != F.col("low"))))


def decide(cores: DataFrame, words: DataFrame, rules: DataFrame, parts: Parts = Parts()) -> DataFrame:
    """(low, out, how) of (low): the cores that change, what to, and by which part."""
    run = cores.select("low", *(F.lit(x).alias(n) for n, x in (("lookup", parts.lookup), ("leet", parts.leet), ("censor", parts.censor), ("words_of", ""), ("rules_of", ""))))
    return decide_all(run, words.withColumn("words_of", F.lit("")), rules.withColumn("rules_of", F.lit("")))


def normalize(df: DataFrame, id_col: str, text_col: str, words: DataFrame, rules: DataFrame, parts: Parts = Parts()) -> DataFrame:
    """(id, normalized) for unique ids. Tokens are joined by single blanks; null texts stay null.

    Texts are put together again from their changed tokens alone: unchanged texts never enter the second shuffle. What is joined by broadcast the planner
    decides by size.
    """
    base = df.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts"), F.col(text_col).isNull().alias("none"))
    renewed = changed_tokens(base.select(F.explode("ts").alias("t")), words, rules, parts)
    hits = base.select("id", F.posexplode("ts").alias("pos", "t")).join(renewed, "t")
    changed = hits.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "renewed"))).alias("new"))
    text = F.array_join(F.transform("ts", lambda t, i: F.coalesce(F.element_at("new", i), t)), " ")
    return base.join(changed, "id", "left").select("id", F.when(~F.col("none"), F.when(F.col("new").isNull(), F.array_join("ts", " ")).otherwise(text)).alias("normalized"))


def changed_tokens(occurrences: DataFrame, words: DataFrame, rules: DataFrame, parts: Parts = Parts()) -> DataFrame:
    """(t, renewed) of (t): the distinct tokens that change. Only distinct tokens are taken apart, and once: they are written down, as two branches read them."""
    lead, middle, trail = punct_parts(F.col("t"))
    distinct = occurrences.distinct().where(has_letter(F.col("t"))).select("t", lead.alias("lead"), F.lower(middle).alias("low"), trail.alias("trail"))
    distinct = checkpointed(distinct)
    return distinct.join(decide(distinct.select("low"), words, rules, parts), "low").select("t", F.concat("lead", "out", "trail").alias("renewed"))
