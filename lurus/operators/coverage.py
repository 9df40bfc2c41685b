"""What each component and each share of a resource is worth. All runs are one plan over the distinct cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurus.functions.text import blind_leet
from lurus.operators.normalize import Parts, decide_all
from lurus.operators.ranking import cut_by_rank
from lurus.operators.resources import small
from lurus.operators.scoring import scope_runs

CONFIGS = {
    "full": Parts(),
    "lookup": Parts(True, False, False),
    "leet": Parts(False, True, False),
    "censor": Parts(False, False, True),
    "lookup+leet": Parts(True, True, False),
    "lookup+censor": Parts(True, False, True),
    "leet+censor": Parts(False, True, True),
}


def ablation(scope: DataFrame, words: DataFrame, rules: DataFrame) -> DataFrame:
    """(config, tp, fp, fn, p, r, f1, f05) with each set of components on, and for the blind baseline. Only distinct cores are decided."""
    low = scope.select("low").distinct()
    runs = F.array(*(F.struct(F.lit(n).alias("config"), F.lit(p.lookup).alias("lookup"), F.lit(p.leet).alias("leet"), F.lit(p.censor).alias("censor")) for n, p in CONFIGS.items()))
    cores = low.select("low", F.explode(runs).alias("c")).select("low", "c.*", F.lit("").alias("words_of"), F.lit("").alias("rules_of"))
    changes = decide_all(cores, words.withColumn("words_of", F.lit("")), rules.withColumn("rules_of", F.lit("")), "config").select("config", "low", "out")
    blind = low.select(F.lit("blind").alias("config"), "low", blind_leet(F.col("low")).alias("out")).where("out <> low")
    names = F.explode(F.array(*map(F.lit, [*CONFIGS, "blind"]))).alias("config")
    return scope_runs(scope.select("*", names), changes.union(blind), "config")


def parts_of(resource: DataFrame, key: str, fractions: list[float], seeds: int) -> DataFrame:
    """(part, *columns): for each seed and fraction the first round(n * fraction) rows in hashed order of the key. part is `<seed>|<fraction>`."""
    n = resource.count()
    drawn = resource.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    cuts = resource.sparkSession.createDataFrame([(s, f"{s}|{f}", 0, round(n * f)) for s in range(seeds) for f in fractions], "seed int, part string, lo long, hi long").where("hi > 0")
    return cut_by_rank(drawn, ["seed"], key, small(cuts), F.col("seed")).select("part", *resource.columns)


def curve(scope: DataFrame, words: DataFrame, rules: DataFrame, fractions: tuple[float, ...] = (0, 0.25, 0.5, 0.75, 1), seeds: int = 5) -> DataFrame:
    """(exp, frac, mean_f05, sd_f05, runs): scores with shares of the rules, and of the lexicon. 0 and 1 need no more than one seed."""
    between = [float(f) for f in fractions if 0 < f < 1]
    # a run's name of its share: all, none, or a part
    name = lambda f, s: "" if f >= 1 else "none" if f <= 0 else f"{s}|{float(f)}"
    runs = [(exp, float(f), s, "" if exp == "rules" else name(f, s), name(f, s) if exp == "rules" else "") for exp in ("rules", "lexicon") for f in fractions for s in range(seeds if 0 < f < 1 else 1)]
    run = F.array(*(F.struct(F.lit(f"{e}|{f}|{s}").alias("run"), F.lit(e).alias("exp"), F.lit(f).alias("frac"), F.lit(w).alias("words_of"), F.lit(r).alias("rules_of")) for e, f, s, w, r in runs))
    both = lambda x, key, own: x.withColumn(own, F.lit("")).unionByName(parts_of(x, key, between, seeds).withColumnRenamed("part", own)) if between else x.withColumn(own, F.lit(""))
    cores = scope.select("low").distinct().select("low", F.explode(run).alias("c")).select("low", "c.run", "c.words_of", "c.rules_of", *(F.lit(True).alias(x) for x in ("lookup", "leet", "censor")))
    changes = decide_all(cores, both(words, "w", "words_of"), both(rules, "variant", "rules_of"), "run").select("run", "low", "out")
    scored = scope_runs(scope.select("*", F.explode(run).alias("c")).select("low", "gold", "clean", "c.run", "c.exp", "c.frac"), changes, "run", "exp", "frac")
    return scored.groupBy("exp", "frac").agg(F.avg("f05").alias("mean_f05"), F.stddev_pop("f05").alias("sd_f05"), F.count("*").alias("runs"))
