"""Controlled damage: spelling and typing errors, slang substitution, and a character channel. All draws are hashes of (seed, id, place)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurus.functions.stats import draw, four_uniforms, let
from lurus.functions.text import tokens
from lurus.operators.resources import small
from lurus.plans.session import spread

#: Keys beside each key, letter patterns that are often confused, and shapes that recognisers confuse.
BESIDE = {
    "a": "sqwz", "b": "vghn", "c": "xdfv", "d": "serfcx", "e": "wsdr", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "i": "ujko", "j": "huikmn", "k": "jiolm", "l": "kop", "m": "njk",
    "n": "bhjm", "o": "iklp", "p": "ol", "q": "wa", "r": "edft", "s": "aqwdxz", "t": "rfgy", "u": "yhji", "v": "cfgb", "w": "qase", "x": "zsdc", "y": "tghu", "z": "asx",
}
PATTERNS = (
    ("ai", "ay"), ("au", "aw"), ("ei", "ey"), ("kk", "k"), ("ll", "l"), ("nn", "n"), ("ss", "s"), ("tt", "t"), ("k", "kk"), ("l", "ll"), ("n", "nn"), ("s", "ss"), ("t", "tt"),
    ("f", "v"), ("v", "f"), ("z", "s"), ("s", "z"), ("ny", "ni"), ("ng", "n"), ("kh", "k"), ("ph", "f"), ("th", "t"), ("mem", "mem"), ("men", "meng"), ("meng", "men"), ("ke", "ke-"),
    ("di", "di-"), ("kan", "in"), ("an", "nya"),
)
SHAPES = (("l", "1"), ("0", "o"), ("1", "i"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h"))
#: Outcomes that a character channel may have in all.
MOST_OUTCOMES = 200_000
MODES = {"typographic": ("adjacent", "double", "swap", "shape"), "spelling": ("omit", "swap", "vowel", "pattern")}


def _pairs(pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))


def _like(case_of: Column, letter: Column) -> Column:
    return F.when(F.upper(case_of) == case_of, F.upper(letter)).otherwise(letter)


def _replaced(core: Column, low: Column, pairs: tuple[tuple[str, str], ...], u: Column) -> Column:
    """One of the patterns that occur in a core, its first occurrence replaced."""
    fit = F.filter(_pairs(pairs), lambda p: F.contains(low, p["a"]))

    def replace(f: Column) -> Column:
        def with_pattern(p: Column) -> Column:
            at = F.position(p["a"], low)
            new = F.concat(F.substring(low, F.lit(1), at - 1), p["b"], F.substr(low, at + F.length(p["a"])))
            return F.when(F.substring(core, 1, 1) == F.substring(low, 1, 1), new).otherwise(F.concat(F.upper(F.substring(new, 1, 1)), F.substr(new, F.lit(2))))

        return F.when(F.size(f) > 0, let(F.get(f, F.floor(u * F.size(f)).cast("int")), with_pattern)).otherwise(core)

    return let(fit, replace)


def damaged(word: Column, mode: str, *seed: Column | int) -> Column:
    """A word with one error of the mode; marks at its ends stay, words of fewer than three letters are left alone."""
    beside = F.create_map(*(F.lit(x) for kv in BESIDE.items() for x in kv))

    def damage(x: Column) -> Column:
        core, low, u = x["core"], F.lower(x["core"]), x["u"]
        n = F.length(core)
        take = lambda a, k: F.substr(core, a, k)
        one = F.lit(1)
        place = lambda first, count: (F.lit(first) + F.floor(u["b"] * count)).cast("int")

        def letter_at(at: Column, choices: Column) -> Column:
            new = lambda c: F.substr(c, (1 + F.floor(u["c"] * F.length(c))).cast("int"), one)
            return let(choices, lambda c: F.when(F.length(c) > 0, F.concat(take(one, at - 1), _like(take(at, one), new(c)), F.substr(core, at + 1))).otherwise(core))

        def swapped(at: Column) -> Column:
            return F.concat(take(one, at - 1), take(at + 1, one), take(at, one), F.substr(core, at + 2))

        def vowel(places: Column) -> Column:
            at = F.get(places, F.floor(u["b"] * F.size(places)).cast("int"))
            return F.when(F.size(places) > 0, let(at, lambda i: letter_at(i, F.replace(F.lit("aeiou"), F.substr(low, i, one))))).otherwise(core)

        done = {
            "adjacent": lambda: let(place(1, n), lambda i: letter_at(i, F.coalesce(F.try_element_at(beside, F.substr(low, i, one)), F.lit("")))),
            "double": lambda: let(place(1, n), lambda i: F.concat(take(one, i), F.substr(core, i))),
            "swap": lambda: let(place(1, n - 1), swapped),
            "shape": lambda: _replaced(core, low, SHAPES, u["c"]),
            "omit": lambda: let(place(2, n - 2), lambda i: F.concat(take(one, i - 1), F.substr(core, i + 1))),
            "vowel": lambda: let(F.filter(F.sequence(one, n), lambda i: F.substr(low, i, one).isin(*"aeiou")), vowel),
            "pattern": lambda: _replaced(core, low, PATTERNS, u["c"]),
        }
        ops = MODES[mode]
        op, out = F.floor(u["a"] * len(ops)), core
        for k, name in enumerate(ops):
            out = F.when(op == k, done[name]()).otherwise(out)
        return F.when(n < 3, x["word"]).otherwise(F.concat(x["head"], out, x["tail"]))

    part = lambda n: F.regexp_extract(word, r"(?s)^(\P{L}*)(.*?)(\P{L}*)$", n)
    return let(F.struct(word.alias("word"), part(1).alias("head"), part(2).alias("core"), part(3).alias("tail"), four_uniforms(*seed).alias("u")), damage)


def inject_spelling(df: DataFrame, id_col: str, text: str, mode: str, errors: int | None = None, seed: int = 42) -> DataFrame:
    """(id, damaged): up to `errors` words of four letters or more get one error each; texts of fewer than two words stay. Row by row, without a shuffle."""
    base, ident = spread(df.select(F.col(id_col).alias("id"), F.col(text).alias("t"))).withColumn("ts", tokens(F.col("t"))), F.col("id")
    most = F.lit(errors) if errors is not None else 1 + draw(seed, ident, "n") % F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.size("ts") / 5)))
    order = F.transform(F.filter(F.transform("ts", lambda w, i: F.struct(draw(seed, ident, i, "w").alias("r"), i.alias("i"), F.length(w).alias("n"))), lambda x: x["n"] >= 4), lambda x: F.struct(x["r"].alias("r"), x["i"].alias("i")))
    chosen = F.transform(F.slice(F.array_sort(order), F.lit(1), most.cast("int")), lambda x: x["i"])
    new = F.transform("ts", lambda w, i: F.when(F.array_contains(F.col("chosen"), i), damaged(w, mode, F.lit(seed), ident, i)).otherwise(w))
    return base.withColumn("chosen", chosen).select("id", F.when((F.size("ts") >= 2) & (F.size("chosen") > 0), F.array_join(new, " ")).otherwise(F.col("t")).alias("damaged"))


def inject_slang(df: DataFrame, id_col: str, text: str, rules: DataFrame, most: int = 2, seed: int = 42) -> DataFrame:
    """(id, damaged) for unique ids: up to `most` words that the rules (formal, variants) know, first in hashed order, become one of their variants. Of
    the marks at a word's end the first of `.,!?;:` that it ends with is kept."""
    base = df.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("ts"), F.col(text).alias("t"))
    flat = base.select("id", F.posexplode("ts").alias("pos", "w"))
    flat = flat.withColumn("formal", F.regexp_replace(F.lower("w"), r"[.,!?;:]+$", "")).join(small(rules), "formal")
    order = Window.partitionBy("id").orderBy(draw(seed, F.col("id"), F.col("pos")), "pos")
    variant = F.get("variants", (draw(seed, F.col("id"), F.col("pos"), "v") % F.size("variants")).cast("int"))
    new = F.concat(variant, F.regexp_extract("w", r"([.,!?;:])$", 1))
    hit = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", new))).alias("new"))
    out = F.array_join(F.transform("ts", lambda w, i: F.coalesce(F.element_at("new", i), w)), " ")
    return base.join(hit, "id", "left").select("id", F.when(F.col("new").isNotNull(), out).otherwise(F.col("t")).alias("damaged"))


def through_channel(df: DataFrame, id_col: str, text: str, channel: DataFrame, insertions: DataFrame, ins_rate: float, scale: float = 1.0, sub_only: bool = False, keep_space: bool = True, seed: int = 13) -> DataFrame:
    """(id, damaged): each character drawn from the channel's outcomes for it, row by row and without a shuffle.

    channel: (ch, outcome, n), outcome `=x` or `DEL`; insertions: (ch, n). Characters that the channel lacks pass. A deletion or substitution that was
    drawn happens with probability `scale`; an insertion may follow any character but a kept blank and a deleted one. With sub_only nothing is deleted or
    inserted. The channel, whose size the alphabet bounds, becomes a literal map to sorted (upper bound, outcome) steps; more than MOST_OUTCOMES rows
    are refused.
    """
    steps, ins = _steps(channel, "ch", "outcome"), _steps(insertions.select(F.lit("").alias("k"), "ch", "n"), "k", "ch").get("", [])
    table = F.from_json(F.lit(json.dumps(steps)), "map<string,array<struct<hi:double,x:string>>>")
    extra = F.from_json(F.lit(json.dumps(ins)), "array<struct<hi:double,x:string>>")
    drawn = lambda s, u: F.get(F.filter(s, lambda x: x["hi"] > u), F.lit(0))["x"]

    def one(ch: Column, at: Column) -> Column:
        def out(u: Column) -> Column:
            def act(o: Column) -> Column:
                gone = (o == "DEL") & (u["b"] < scale) & F.lit(not sub_only)
                kept = F.when(o.startswith("=") & (u["b"] < scale), F.substr(o, F.lit(2))).otherwise(ch)
                added = F.when((u["c"] < ins_rate * scale) & F.lit(not sub_only), drawn(extra, u["d"]))
                return F.when(F.coalesce(gone, F.lit(False)), "").otherwise(F.concat(F.coalesce(kept, ch), F.coalesce(added, F.lit(""))))

            return let(drawn(F.try_element_at(table, ch), u["a"]), act)

        changed = let(four_uniforms(seed, F.col(id_col), at), out)
        return F.when(ch == " ", ch).otherwise(changed) if keep_space else changed

    chars = F.filter(F.split(F.col(text), ""), lambda c: c != "")
    return spread(df.select(id_col, text)).select(F.col(id_col).alias("id"), F.array_join(F.transform(chars, one), "").alias("damaged"))


def _steps(counts: DataFrame, key: str, outcome: str) -> dict[str, list[dict]]:
    rows = counts.where("n > 0").limit(MOST_OUTCOMES + 1).collect()
    if len(rows) > MOST_OUTCOMES:
        raise ValueError(f"a channel has {MOST_OUTCOMES} outcomes at most")
    out: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r[key], -r.n, r[outcome])):
        out.setdefault(r[key], []).append({"hi": r.n, "x": r[outcome]})
    for steps in out.values():
        total, so_far = sum(s["hi"] for s in steps), 0
        for s in steps:
            so_far += s["hi"]
            s["hi"] = so_far / total
    return out


def repeated(df: DataFrame, times: int) -> DataFrame:
    """Each row `times` times, with rep."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
