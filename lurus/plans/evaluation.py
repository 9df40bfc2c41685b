"""Queries: normalisation, evaluation, resampling and gating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurus.functions import text as T
from lurus.functions.stats import binomial_p, ratio
from lurus.operators import align, coverage, gating, resampling, resources, scoring
from lurus.operators.normalize import decide, normalize
from lurus.plans.registry import Registry, char_distance, draw, nopunct, over, prf, squeezed, token_list, word_distance
from lurus.plans.session import checkpointed, table

query = Registry()
PRED = "(SELECT DISTINCT id, category, source, hyp, kalimat_koreksi, gec_score FROM predictions)"
GROUP = f"coalesce(upper({squeezed('category')}), '?')"
FACTS = f"""p AS (SELECT id, {GROUP} AS category, coalesce(gec_score, -99.0) AS score, {nopunct('source')} AS s, {nopunct('hyp')} AS h, {nopunct('kalimat_koreksi')} AS r FROM {PRED}),
f AS (SELECT id, category, score, length(r) AS r_len, len(list_filter(string_split(r, ' '), lambda t: t <> '')) AS r_words, levenshtein(s, r) AS c_source, levenshtein(h, r) AS c_hyp,
{word_distance('s', 'r')} AS w_source, {word_distance('h', 'r')} AS w_hyp, (s = r)::INT AS x_source, (h = r)::INT AS x_hyp,
levenshtein(s, r) / greatest(length(r), 1)::DOUBLE AS cer_source, levenshtein(h, r) / greatest(length(r), 1)::DOUBLE AS cer_hyp FROM p)"""
SETS = "GROUP BY GROUPING SETS ((category), ())"
TOTAL = "category, grouping(category)::BIGINT AS is_total"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "predictions").select("id", "category", "source", "hyp", "kalimat_koreksi", "gec_score").distinct()


def facts(spark: SparkSession, sf_dir: str, mode: str = "lower_nopunct") -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("category", F.coalesce(F.upper(T.squeeze(F.col("category"))), F.lit("?"))).withColumn("score", F.coalesce("gec_score", F.lit(gating.NO_SCORE)))
    return scoring.facts(rows, {"source": "source", "hyp": "hyp"}, "kalimat_koreksi", mode, ("id", "category", "score"))


def r6(c) -> Column:
    return F.round(c, 6)


def by_category(df: DataFrame, *metrics) -> DataFrame:
    return scoring.with_total(df, "category", *metrics).withColumn("is_total", F.col("is_total").cast("long"))


@query(f"""WITH {FACTS} SELECT {TOTAL}, count(*) AS n, sum(c_source)::BIGINT AS edits_source, sum(c_hyp)::BIGINT AS edits_hyp, sum(r_len)::BIGINT AS ref_chars,
round({over('sum(c_source)', 'sum(r_len)')}, 6) AS cer_source, round({over('sum(c_hyp)', 'sum(r_len)')}, 6) AS cer_hyp FROM f {SETS}""")
def cer_by_category(spark, sf_dir):
    m = [F.count("*").alias("n"), F.sum("c_source").alias("edits_source"), F.sum("c_hyp").alias("edits_hyp"), F.sum("r_len").alias("ref_chars"), r6(scoring.micro("c_source", "r_len")).alias("cer_source"), r6(scoring.micro("c_hyp", "r_len")).alias("cer_hyp")]
    return by_category(facts(spark, sf_dir), *m)


def _cer_sql(mode: str, f) -> str:
    return f"SELECT '{mode}' AS mode, round({over(f'sum({char_distance(f(chr(115)), f(chr(114)))})', f'sum(length({f(chr(114))}))')}, 6) AS cer FROM q"


@query(f"""WITH q AS (SELECT coalesce(source, '') AS s, coalesce(kalimat_koreksi, '') AS r FROM {PRED})
{_cer_sql('raw', lambda x: x)} UNION ALL {_cer_sql('lower', lambda x: squeezed(f'lower({x})'))} UNION ALL {_cer_sql('lower_nopunct', nopunct)}""")
def cer_modes(spark, sf_dir):
    """Micro rates under each normal form."""
    rows = predictions(spark, sf_dir).select(F.col("source").alias("s"), F.col("kalimat_koreksi").alias("r"))
    flat = rows.select(F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), T.normal(F.col("s"), m).alias("s"), T.normal(F.col("r"), m).alias("r")) for m in T.MODES))).alias("x")).select("x.*")
    return flat.groupBy("mode").agg(r6(ratio(F.sum(F.levenshtein("s", "r")).cast("double"), F.sum(F.length("r")).cast("double"))).alias("cer"))


@query(f"""WITH {FACTS} SELECT {TOTAL}, sum(w_source)::BIGINT AS edits_source, sum(w_hyp)::BIGINT AS edits_hyp, sum(r_words)::BIGINT AS ref_words,
round({over('sum(w_hyp)', 'sum(r_words)')}, 6) AS wer_hyp FROM f {SETS}""")
def wer_by_category(spark, sf_dir):
    return by_category(facts(spark, sf_dir), F.sum("w_source").alias("edits_source"), F.sum("w_hyp").alias("edits_hyp"), F.sum("r_words").alias("ref_words"), r6(scoring.micro("w_hyp", "r_words")).alias("wer_hyp"))


@query(f"""WITH {FACTS} SELECT {TOTAL}, round(avg(cer_source), 6) AS cer_source, round(avg(cer_hyp), 6) AS cer_hyp, round(avg(w_hyp / greatest(r_words, 1)::DOUBLE), 6) AS wer_hyp,
round(100 * avg(x_hyp), 6) AS exact_percent FROM f {SETS}""")
def macro_scores(spark, sf_dir):
    wer = F.col("w_hyp") / F.greatest("r_words", F.lit(1))
    return by_category(facts(spark, sf_dir), r6(F.avg("cer_source")).alias("cer_source"), r6(F.avg("cer_hyp")).alias("cer_hyp"), r6(F.avg(wer)).alias("wer_hyp"), r6(100 * F.avg("x_hyp")).alias("exact_percent"))


@query(f"""WITH {FACTS}, b AS (SELECT CASE WHEN cer_hyp = 0 THEN '0 exact' WHEN cer_hyp <= 0.1 THEN '1 to 0.1' WHEN cer_hyp <= 0.3 THEN '2 to 0.3' WHEN cer_hyp <= 0.5 THEN '3 to 0.5' ELSE '4 above' END AS band FROM f)
SELECT band, count(*) AS n FROM b GROUP BY 1""")
def cer_buckets(spark, sf_dir):
    c = F.col("cer_hyp")
    band = F.when(c == 0, "0 exact").when(c <= 0.1, "1 to 0.1").when(c <= 0.3, "2 to 0.3").when(c <= 0.5, "3 to 0.5").otherwise("4 above")
    return facts(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {FACTS} SELECT id, category, round(cer_hyp, 6) AS cer FROM f ORDER BY cer_hyp DESC, id LIMIT 10")
def worst_k(spark, sf_dir):
    return facts(spark, sf_dir).orderBy(F.col("cer_hyp").desc(), "id").limit(10).select("id", "category", r6("cer_hyp").alias("cer"))


@query(f"WITH {FACTS} SELECT arg_min(category, (c, category)) AS best, arg_max(category, (c, category)) AS worst FROM (SELECT category, round({over('sum(c_hyp)', 'sum(r_len)')}, 9) AS c FROM f GROUP BY 1)")
def best_and_worst(spark, sf_dir):
    c = facts(spark, sf_dir).groupBy("category").agg(F.round(scoring.micro("c_hyp", "r_len"), 9).alias("c"))
    return c.agg(F.min_by("category", F.struct("c", "category")).alias("best"), F.max_by("category", F.struct("c", "category")).alias("worst"))


@query(f"WITH {FACTS} SELECT id, round(avg(cer_hyp) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING), 6) AS running FROM f")
def running_cer(spark, sf_dir):
    return gating.running_mean(facts(spark, sf_dir), "cer_hyp", "id").select("id", r6("running").alias("running"))


KIND = """list_transform(range(1, greatest(len(s), len(h), len(r)) + 1), lambda i: CASE WHEN coalesce(s[i], '') <> coalesce(r[i], '') AND coalesce(h[i], '') = coalesce(r[i], '') THEN 'tp'
WHEN coalesce(s[i], '') <> coalesce(r[i], '') THEN 'fn' WHEN coalesce(h[i], '') <> coalesce(s[i], '') AND coalesce(h[i], '') <> coalesce(r[i], '') THEN 'fp' END)"""


@query(f"""WITH t AS (SELECT {GROUP} AS category, {token_list('source')} AS s, {token_list('hyp')} AS h, {token_list('kalimat_koreksi')} AS r FROM {PRED}),
k AS (SELECT category, {KIND} AS k FROM t), c AS (SELECT category, len(list_filter(k, lambda x: x = 'tp')) AS tp, len(list_filter(k, lambda x: x = 'fp')) AS fp, len(list_filter(k, lambda x: x = 'fn')) AS fn FROM k)
SELECT {TOTAL}, {prf('sum(tp)', 'sum(fp)', 'sum(fn)')} FROM c {SETS}""")
def token_prf(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(F.coalesce(F.upper(T.squeeze(F.col("category"))), F.lit("?")).alias("category"), scoring.token_counts(F.col("source"), F.col("hyp"), F.col("kalimat_koreksi")).alias("c"))
    rounded = [r6(c).alias(n) if n in ("p", "r", "f1", "f05") else c for c, n in zip(scoring.prf(F.sum("c.tp"), F.sum("c.fp"), F.sum("c.fn")), ("tp", "fp", "fn", "p", "r", "f1", "f05"))]
    return by_category(rows, *rounded)


# Normaliser

LEX = f"lex AS (SELECT w, max(f)::BIGINT AS f FROM (SELECT lower({squeezed('w')}) AS w, f FROM lexicon) WHERE regexp_full_match(w, '\\p{{L}}+') AND length(w) >= 2 AND f >= 2 GROUP BY 1)"
RUL = f"""rul AS (SELECT variant, min(target) AS target FROM (SELECT lower({squeezed('variant')}) AS variant, lower({squeezed('formal')}) AS target FROM algospeak_dict)
WHERE length(variant) >= 2 AND NOT contains(variant, ' ') AND target <> '' GROUP BY 1 HAVING count(DISTINCT target) = 1)"""


def decide_sql(n: str, lookup: bool = True, leet: bool = True, censor: bool = True, lex: str = "lex", rul: str = "rul") -> str:
    """CTEs that end in `changes<n>` (low, o, how), from `lows` (low) and the tables of words and rules."""
    stars = f"pow(26, length(low) - length(replace(low, '*', '')))" if censor else "1"
    twos = "pow(2, length(low) - length(translate(low, '1v', '')))" if leet else "1"
    signs = "".join(f"WHEN c = '{k}' THEN '{v}' " for k, v in {"4": "a", "@": "a", "3": "e", "0": "o", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g", "2": "z", "1": "[il]", "!": "i", "v": "[uv]"}.items()) if leet else ""
    star = "WHEN c = '*' THEN '[a-z]' " if censor else ""
    return f"""known{n} AS (SELECT low, w IS NOT NULL AS valid, target FROM (SELECT DISTINCT low FROM lows WHERE regexp_matches(low, '\\p{{L}}')) LEFT JOIN {lex} ON low = w LEFT JOIN {rul} ON low = variant),
rest{n} AS (SELECT low FROM known{n} WHERE (target IS NULL OR valid OR NOT {lookup}) AND (regexp_matches(low, '[4@305$78921!*]') OR (NOT valid AND contains(low, 'v'))) AND {twos} * {stars} <= 4000),
pat{n} AS (SELECT low, array_to_string(list_transform(string_split(low, ''), lambda c: CASE {signs}{star}WHEN regexp_matches(c, '\\p{{L}}') THEN c ELSE '#' END), '') AS pat FROM rest{n}),
hits{n} AS (SELECT low, w, f, list_transform(range(1, length(w) + 1), lambda i: CASE WHEN low[i] = 'v' AND w[i] = 'v' THEN 'a' WHEN low[i] = 'v' AND w[i] = 'u' THEN 'b' ELSE w[i] END) AS o FROM pat{n} JOIN {lex} ON length(low) = length(w) AND regexp_full_match(w, pat)),
best{n} AS (SELECT low, (list(w ORDER BY f DESC, o))[1] AS o FROM hits{n} GROUP BY 1),
changes{n} AS (SELECT low, target AS o, 'lookup' AS how FROM known{n} WHERE target IS NOT NULL AND NOT valid AND {lookup} UNION ALL SELECT low, o, 'decoded' FROM best{n} WHERE o <> low)"""


OCR = "(SELECT DISTINCT crop_id, teks_ocr FROM ocr_outputs)"
FLAT = f"""base AS (SELECT crop_id, teks_ocr, {token_list('teks_ocr')} AS ts FROM {OCR}),
flat AS (SELECT crop_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM base),
parts AS (SELECT crop_id, pos, t, regexp_extract(t, '(?s)^([[:punct:]]*)(.*?)([[:punct:]]*)$', 1) AS lead, lower(regexp_extract(t, '(?s)^([[:punct:]]*)(.*?)([[:punct:]]*)$', 2)) AS low, regexp_extract(t, '(?s)^([[:punct:]]*)(.*?)([[:punct:]]*)$', 3) AS trail FROM flat),
lows AS (SELECT low FROM parts)"""


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ocr_outputs").select("crop_id", "teks_ocr").distinct()


def words_and_rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return resources.lexicon(table(spark, sf_dir, "lexicon")), resources.lookup(table(spark, sf_dir, "algospeak_dict"))


NORM_TEXT = f"""WITH {LEX}, {RUL}, {FLAT}, {decide_sql('')}, joined AS (SELECT crop_id, string_agg(CASE WHEN o IS NULL THEN t ELSE lead || o || trail END, ' ' ORDER BY pos) AS x FROM parts LEFT JOIN changes USING (low) GROUP BY 1)
SELECT crop_id, CASE WHEN teks_ocr IS NOT NULL THEN coalesce(x, '') END AS normalized FROM base LEFT JOIN joined USING (crop_id)"""


@query(NORM_TEXT)
def norm_text(spark, sf_dir):
    return normalize(ocr(spark, sf_dir), "crop_id", "teks_ocr", *words_and_rules(spark, sf_dir)).withColumnRenamed("id", "crop_id")


NORM_CER = f"""WITH {LEX}, {RUL}, {FLAT}, {decide_sql('')}, joined AS (SELECT crop_id, string_agg(CASE WHEN o IS NULL THEN t ELSE lead || o || trail END, ' ' ORDER BY pos) AS x FROM parts LEFT JOIN changes USING (low) GROUP BY 1),
g AS (SELECT {GROUP} AS category, {nopunct('teks_ocr')} AS s, {nopunct('x')} AS h, {nopunct('kalimat_koreksi')} AS r FROM (SELECT DISTINCT crop_id, category, teks_ocr, kalimat_koreksi FROM ocr_outputs) LEFT JOIN joined USING (crop_id))
SELECT {TOTAL}, count(*) AS n, round({over('sum(levenshtein(s, r))', 'sum(length(r))')}, 6) AS cer_before, round({over('sum(levenshtein(h, r))', 'sum(length(r))')}, 6) AS cer_after FROM g {SETS}"""


def norm_rates(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    rows = table(spark, sf_dir, "ocr_outputs").select("crop_id", "category", source, "kalimat_koreksi").distinct()
    mended = normalize(rows.select("crop_id", source).distinct(), "crop_id", source, *words_and_rules(spark, sf_dir)).withColumnRenamed("id", "crop_id")
    joined = rows.join(mended, "crop_id", "left").withColumn("category", F.coalesce(F.upper(T.squeeze(F.col("category"))), F.lit("?")))
    facts_ = scoring.facts(joined, {"before": source, "after": "normalized"}, "kalimat_koreksi", "lower_nopunct", ("category",))
    return by_category(facts_, F.count("*").alias("n"), r6(scoring.micro("c_before", "r_len")).alias("cer_before"), r6(scoring.micro("c_after", "r_len")).alias("cer_after"))


@query(NORM_CER)
def norm_cer(spark, sf_dir):
    """The flagship: how far normalisation brings recognised text towards its correction, by category and in all."""
    return norm_rates(spark, sf_dir, "teks_ocr")


@query(NORM_CER.replace("teks_ocr", "paddleocr_out"))
def norm_cer_alternative(spark, sf_dir):
    """The same of the other recogniser's text."""
    return norm_rates(spark, sf_dir, "paddleocr_out")


@query(f"WITH {LEX}, {RUL}, {FLAT}, {decide_sql('')} SELECT low, o AS decided, how FROM changes")
def norm_changes(spark, sf_dir):
    low = ocr(spark, sf_dir).select(F.explode(T.tokens(F.col("teks_ocr"))).alias("t")).select(F.lower(T.punct_parts(F.col("t"))[1]).alias("low"))
    return decide(low, *words_and_rules(spark, sf_dir)).withColumnRenamed("out", "decided")


@query(f"SELECT crop_id, translate(teks_ocr, '430', 'aeo') AS decoded FROM {OCR}")
def blind_leet(spark, sf_dir):
    return ocr(spark, sf_dir).select("crop_id", T.blind_leet(F.col("teks_ocr")).alias("decoded"))


@query(f"WITH {LEX} SELECT * FROM lex")
def lexicon_words(spark, sf_dir):
    return words_and_rules(spark, sf_dir)[0]


@query(f"WITH {RUL} SELECT * FROM rul")
def rule_lookup(spark, sf_dir):
    return words_and_rules(spark, sf_dir)[1]


@query(f"""WITH {LEX}, g AS (SELECT DISTINCT regexp_replace(t, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS w FROM (SELECT lower(unnest({token_list('kalimat_koreksi')})) AS t FROM ocr_outputs)),
a AS (SELECT w, f FROM lex UNION ALL SELECT w, 2 FROM g WHERE regexp_full_match(w, '\\p{{L}}+') AND length(w) >= 2 AND w NOT IN (SELECT w FROM lex)) SELECT w, f::BIGINT AS f FROM a""")
def lexicon_augmented(spark, sf_dir):
    return resources.augmented(words_and_rules(spark, sf_dir)[0], table(spark, sf_dir, "ocr_outputs"), "kalimat_koreksi")


CORE = "lower(regexp_replace({0}, '^[[:punct:]]+|[[:punct:]]+$', '', 'g'))"
SCOPE = f"""ann AS (SELECT DISTINCT ann_id, sentences FROM annotations), se AS (SELECT ann_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS n FROM ann),
sn AS (SELECT concat_ws(':', ann_id, n - 1) AS id, s.teks_ocr AS txt, coalesce(list_filter(s.errors, lambda e: e IS NOT NULL), []) AS errors FROM se WHERE s IS NOT NULL),
tk AS (SELECT id, unnest({token_list('txt')}) AS t, errors FROM sn),
sc AS (SELECT id, {CORE.format('t')} AS low, list_filter(errors, lambda e: upper({squeezed('e.category')}) = 'ALG' AND len({token_list('e.token_salah')}) = 1 AND {squeezed("coalesce(e.token_benar, '')")} <> '') AS g,
list_transform(flatten(list_transform(errors, lambda e: {token_list('e.token_salah')})), lambda w: {CORE.format('w')}) AS wrong FROM tk),
scope AS (SELECT id, low, {CORE.format(squeezed('list_reverse(list_filter(g, lambda e: ' + CORE.format(squeezed('e.token_salah')) + ' = low))[1].token_benar'))} AS gold, NOT coalesce(list_contains(wrong, low), false) AS clean FROM sc WHERE low <> ''),
lows AS (SELECT DISTINCT low FROM scope)"""


def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "annotations").select("ann_id", "sentences").distinct()
    s = a.select("ann_id", F.posexplode("sentences").alias("n", "s")).where("s is not null")
    errors = F.coalesce(F.filter("s.errors", lambda e: e.isNotNull()), F.array().cast("array<struct<token_salah:string,token_benar:string,category:string>>"))
    return scoring.scope_tokens(s.select(F.concat_ws(":", "ann_id", "n").alias("id"), F.col("s.teks_ocr").alias("text"), errors.alias("errors")), "ALG")


def _ablation_sql() -> str:
    names = {c: f"_{k}" for k, c in enumerate(coverage.CONFIGS)}
    ctes = ", ".join(decide_sql(names[c], p.lookup, p.leet, p.censor) for c, p in coverage.CONFIGS.items())
    blind = "changes_b AS (SELECT low, translate(low, '430', 'aeo') AS o FROM lows WHERE translate(low, '430', 'aeo') <> low)"
    counts = prf("count(*) FILTER (gold IS NOT NULL AND x = gold)", "count(*) FILTER (gold IS NULL AND clean AND x <> low)", "count(*) FILTER (gold IS NOT NULL AND x <> gold)")
    one = lambda config, n: f"SELECT '{config}' AS config, {counts} FROM (SELECT low, gold, clean, coalesce(o, low) AS x FROM scope LEFT JOIN changes{n} USING (low))"
    return f"WITH {LEX}, {RUL}, {SCOPE}, {ctes}, {blind} " + " UNION ALL ".join([one(c, n) for c, n in names.items()] + [one("blind", "_b")])


@query(_ablation_sql())
def component_ablation(spark, sf_dir):
    out = coverage.ablation(checkpointed(scope(spark, sf_dir)), *(checkpointed(x) for x in words_and_rules(spark, sf_dir)))
    return out.select("config", "tp", "fp", "fn", *(r6(c).alias(c) for c in ("p", "r", "f1", "f05")))


def _curve_sql() -> str:
    """Each run with its own share of the words or rules, spelled out."""
    ctes, scores = [], []
    for exp, all_, key in (("rules", "rul", "variant"), ("lexicon", "lex", "w")):
        for frac in (0.0, 0.25, 0.5, 0.75, 1.0):
            for seed in range(5 if 0 < frac < 1 else 1):
                n = f"_{exp}_{round(100 * frac)}_{seed}"
                place = f"('0x' || substr(md5(concat_ws('|', '{seed}', {key})), 1, 15))::BIGINT"
                ctes.append(f"part{n} AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (ORDER BY {place}, {key}) AS k FROM {all_}) WHERE k <= round_even({frac} * (SELECT count(*) FROM {all_}), 0))")
                ctes.append(decide_sql(n, **{"rul" if exp == "rules" else "lex": f"part{n}"}))
                counts = prf("count(*) FILTER (gold IS NOT NULL AND x = gold)", "count(*) FILTER (gold IS NULL AND clean AND x <> low)", "count(*) FILTER (gold IS NOT NULL AND x <> gold)").replace(", 6)", ", 15)")
                scores.append(f"SELECT '{exp}' AS exp, {frac}::DOUBLE AS frac, f05 FROM (SELECT {counts} FROM (SELECT low, gold, clean, coalesce(o, low) AS x FROM scope LEFT JOIN changes{n} USING (low)))")
    return f"WITH {LEX}, {RUL}, {SCOPE}, {', '.join(ctes)} SELECT exp, frac, round(avg(f05), 6) AS mean_f05, round(stddev_pop(f05), 6) AS sd_f05, count(*) AS runs FROM ({' UNION ALL '.join(scores)}) GROUP BY 1, 2"


@query(_curve_sql())
def coverage_curve(spark, sf_dir):
    words, rules = (checkpointed(x) for x in words_and_rules(spark, sf_dir))
    return coverage.curve(checkpointed(scope(spark, sf_dir)), words, rules).withColumn("mean_f05", r6("mean_f05")).withColumn("sd_f05", r6("sd_f05"))


@query()
def edit_prf(spark, sf_dir):
    return align.edit_prf(align.edit_sums(predictions(spark, sf_dir), "source", "hyp", "kalimat_koreksi"))


# Resampling and tests

B, PAIRED = 1000, 5000


def _boot(sums: str, b: int = B) -> str:
    return f"ix AS (SELECT row_number() OVER (ORDER BY id) - 1 AS i, * FROM f), n AS (SELECT count(*) AS n FROM f), d AS (SELECT rep, {draw('42', 'rep', 'k')} % n.n AS i FROM range({b}) r(rep), (SELECT i AS k FROM ix), n), reps AS (SELECT rep, {sums} FROM d JOIN ix USING (i) GROUP BY 1)"


@query(f"""WITH {FACTS}, {_boot('sum(c_hyp) AS a, sum(r_len) AS b')}, v AS (SELECT list(a::DOUBLE / b ORDER BY a::DOUBLE / b) AS v FROM reps)
SELECT (SELECT count(*) FROM f) AS n, round((SELECT sum(c_hyp)::DOUBLE / sum(r_len) FROM f), 6) AS point, round(v[1 + floor(0.025 * len(v))::INT], 6) AS lo, round(v[floor(0.975 * len(v))::INT], 6) AS hi FROM v""")
def boot_ci(spark, sf_dir, b=B):
    out = resampling.ratio_interval(checkpointed(facts(spark, sf_dir).select("id", "c_hyp", "r_len")), "id", "c_hyp", "r_len", b)
    return out.select("n", *(r6(c).alias(c) for c in ("point", "lo", "hi")))


@query(f"""WITH {FACTS}, g AS (SELECT id, round(cer_hyp - cer_source, 9) AS diff FROM f), {_boot('sum(diff) AS a', PAIRED).replace('FROM f)', 'FROM g)')}, m AS (SELECT round(a / (SELECT n FROM n), 9) AS m FROM reps), v AS (SELECT list(m ORDER BY m) AS v, avg((m > 0)::INT) AS above FROM m)
SELECT (SELECT n FROM n) AS n, round((SELECT avg(diff) FROM g), 6) AS mean_diff, round(v[1 + floor(0.025 * len(v))::INT], 6) AS lo, round(v[floor(0.975 * len(v))::INT], 6) AS hi, round(2 * least(above, 1 - above), 6) AS p FROM v""")
def paired_boot(spark, sf_dir, b=PAIRED):
    rows = checkpointed(facts(spark, sf_dir).select("id", F.round(F.col("cer_hyp") - F.col("cer_source"), 9).alias("diff")))
    return resampling.paired_bootstrap(rows, "id", "diff", b).select("n", *(r6(c).alias(c) for c in ("mean_diff", "lo", "hi", "p")))


_U = f"({draw('42', 'rep', 'id')}) / 4294967296.0"
_WEIGHT = " + ".join(f"(u > {p})::INT" for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676))


@query(f"""WITH {FACTS}, d AS (SELECT rep, c_hyp, r_len, {_U} AS u FROM f, range(1000) r(rep)), reps AS (SELECT rep, sum(c_hyp * ({_WEIGHT}))::DOUBLE / sum(r_len * ({_WEIGHT})) AS x FROM d GROUP BY 1), v AS (SELECT list(x ORDER BY x) AS v FROM reps)
SELECT round(v[1 + floor(0.025 * len(v))::INT], 6) AS lo, round(v[floor(0.975 * len(v))::INT], 6) AS hi FROM v""")
def boot_ci_poisson(spark, sf_dir):
    reps = resampling.poisson_replicates(facts(spark, sf_dir).select("id", "c_hyp", "r_len"), "id", 1000, 42, "c_hyp", "r_len")
    lo, hi = resampling.interval(F.col("v"))
    return reps.agg(F.sort_array(F.collect_list(ratio(F.col("c_hyp").cast("double"), F.col("r_len").cast("double")))).alias("v")).select(r6(lo).alias("lo"), r6(hi).alias("hi"))


@query(f"""WITH t AS (SELECT id, {token_list('source')} AS s, {token_list('hyp')} AS h, {token_list('kalimat_koreksi')} AS r FROM {PRED}), k AS (SELECT id, {KIND} AS k FROM t),
f AS (SELECT id, len(list_filter(k, lambda x: x = 'tp')) AS tp, len(list_filter(k, lambda x: x = 'fp')) AS fp, len(list_filter(k, lambda x: x = 'fn')) AS fn FROM k),
{_boot('sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn')}, s AS (SELECT f05 FROM (SELECT {prf('tp', 'fp', 'fn').replace('round(', 'round(').replace(', 6)', ', 12)')} FROM reps)), v AS (SELECT list(f05 ORDER BY f05) AS v FROM s)
SELECT (SELECT n FROM n) AS n, (SELECT f05 FROM (SELECT {prf('sum(tp)', 'sum(fp)', 'sum(fn)')} FROM f)) AS point, round(v[1 + floor(0.025 * len(v))::INT], 6) AS lo, round(v[1 + least(floor(0.975 * len(v))::INT, len(v) - 1)], 6) AS hi FROM v""")
def boot_f05(spark, sf_dir, b=B):
    counts = predictions(spark, sf_dir).select("id", scoring.token_counts(F.col("source"), F.col("hyp"), F.col("kalimat_koreksi")).alias("c")).select("id", "c.*")
    return resampling.f_interval(checkpointed(counts), "id", b).select("n", *(r6(c).alias(c) for c in ("point", "lo", "hi")))


@query(f"WITH {FACTS}, v AS (SELECT list(r_len ORDER BY r_len) AS v FROM f) SELECT v[1 + floor(0.5 * len(v))::INT]::BIGINT AS median, v[1 + floor(0.95 * len(v))::INT]::BIGINT AS p95 FROM v")
def length_places(spark, sf_dir):
    """Median and 95th percentile by place, as latencies are reported, of reference lengths."""
    from lurus.plans.indexing import row_index

    rows = row_index(facts(spark, sf_dir).select("id", "r_len"), "r_len", "id")
    n = rows.count()
    pick = lambda share: F.max(F.when(F.col("i") == int(share * n), F.col("r_len"))).cast("long")
    return rows.agg(pick(0.5).alias("median"), pick(0.95).alias("p95"))


@query(f"WITH {LEX}, {RUL}, {SCOPE.replace('SELECT id, unnest(', 'SELECT id, generate_subscripts(' + token_list('txt') + ', 1) - 1 AS pos, unnest(').replace('sc AS (SELECT id,', 'sc AS (SELECT id, pos,').replace('scope AS (SELECT id,', 'scope AS (SELECT id, pos,')}, {decide_sql('')} SELECT id, pos, low, coalesce(o, low) AS predicted, gold, coalesce(o, low) = gold AS hit FROM scope LEFT JOIN changes USING (low) WHERE gold IS NOT NULL ORDER BY id, pos LIMIT 20")
def scope_tokens_report(spark, sf_dir):
    s = checkpointed(scope(spark, sf_dir))
    return scoring.scope_report(s, decide(s.select("low"), *words_and_rules(spark, sf_dir))).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {SCOPE} SELECT {prf('count(*) FILTER (gold IS NOT NULL AND x = gold)', 'count(*) FILTER (gold IS NULL AND clean AND x <> low)', 'count(*) FILTER (gold IS NOT NULL AND x <> gold)')}
FROM (SELECT *, translate(low, '430', 'aeo') AS x FROM scope)""")
def token_function(spark, sf_dir):
    """A Python function of a token, scored like the normaliser."""
    out = scoring.token_function_counts(scope(spark, sf_dir), lambda t: t.replace("4", "a").replace("3", "e").replace("0", "o"))
    return out.select("tp", "fp", "fn", *(r6(c).alias(c) for c in ("p", "r", "f1", "f05")))


@query(f"WITH {FACTS} SELECT round(avg(cer_hyp), 6) AS hyp, round(avg(cer_source), 6) AS source, round(avg(CASE WHEN score >= -3.0 THEN cer_hyp ELSE cer_source END), 6) AS gated, round(avg(least(cer_hyp, cer_source)), 6) AS best FROM f")
def compared_systems(spark, sf_dir):
    """Mean rates of several systems over the same rows: raw, hypothesis, gated, and the better of each row."""
    f = facts(spark, sf_dir)
    gated = gating.gate(F.col("cer_source"), F.col("cer_hyp"), F.col("score"), -3.0)
    return f.agg(r6(F.avg("cer_hyp")).alias("hyp"), r6(F.avg("cer_source")).alias("source"), r6(F.avg(gated)).alias("gated"), r6(F.avg(F.least("cer_hyp", "cer_source"))).alias("best"))


TAIL = "CASE WHEN {0} + {1} = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma({0} + {1} + 1) - lgamma(i + 1) - lgamma({0} + {1} - i + 1) - ({0} + {1}) * ln(2.0))) FROM range(least({0}, {1})::BIGINT + 1) t(i))) END"


@query(f"""WITH {FACTS}, c AS (SELECT count(*) FILTER (cer_source - cer_hyp > 1e-9) AS better, count(*) FILTER (cer_source - cer_hyp < -1e-9) AS worse, count(*) FILTER (abs(cer_source - cer_hyp) <= 1e-9) AS ties FROM f)
SELECT better, worse, ties, round({TAIL.format('better', 'worse')}, 6) AS p FROM c""")
def sign_test(spark, sf_dir):
    return resampling.sign_test(facts(spark, sf_dir), "cer_source", "cer_hyp").withColumn("p", r6("p"))


@query(f"""WITH {FACTS}, c AS (SELECT count(*) FILTER (x_source = 1 AND x_hyp = 0) AS only_a, count(*) FILTER (x_source = 0 AND x_hyp = 1) AS only_b FROM f)
SELECT only_a, only_b, round({TAIL.format('only_a', 'only_b')}, 6) AS p FROM c""")
def mcnemar(spark, sf_dir):
    return resampling.mcnemar(facts(spark, sf_dir), "x_source", "x_hyp").withColumn("p", r6("p"))


# Gating

TAUS = """sv AS (SELECT list(score ORDER BY score) AS v FROM f), qs AS (SELECT unnest(range(0, 101, 10)) AS q),
jq AS (SELECT q, v, len(v) AS n, least(greatest(floor(q * (len(v) + 1) / 100)::BIGINT, 1), len(v) - 1) AS j FROM qs, sv),
taus AS (SELECT q, CASE WHEN q = 0 THEN v[1] WHEN q = 100 THEN v[n] ELSE (v[j] * (100 - (q * (n + 1) - 100 * j)) + v[j + 1] * (q * (n + 1) - 100 * j)) / 100 END AS tau FROM jq)"""


@query(f"WITH {FACTS}, {TAUS} SELECT q, round(tau, 6) AS tau FROM taus")
def score_percentiles(spark, sf_dir):
    return gating.thresholds(facts(spark, sf_dir), "score").select(F.col("q").cast("long").alias("q"), r6("tau").alias("tau"))


@query(f"""WITH {FACTS}, {TAUS} SELECT q, round(sum(CASE WHEN score >= tau THEN c_hyp ELSE c_source END)::DOUBLE / sum(r_len), 6) AS cer, round(avg((score >= tau)::INT), 6) AS applied FROM taus, f GROUP BY q""")
def tau_sweep(spark, sf_dir):
    rows = checkpointed(facts(spark, sf_dir).select("score", "c_source", "c_hyp", "r_len"))
    return gating.sweep(rows, "score", "c_source", "c_hyp", "r_len", gating.thresholds(rows, "score")).select(F.col("q").cast("long").alias("q"), r6("cer").alias("cer"), r6("applied").alias("applied"))


@query(f"""WITH {FACTS}, g AS (SELECT *, score > -2.0 AS applied FROM f), c AS (SELECT count(*) FILTER (applied AND c_hyp < c_source) AS better, count(*) FILTER (applied AND c_hyp > c_source) AS worse, round(100 * avg(applied::INT), 6) AS coverage,
round(sum(CASE WHEN applied THEN c_hyp ELSE c_source END)::DOUBLE / sum(r_len), 6) AS cer FROM g) SELECT *, round({TAIL.format('better', 'worse')}, 6) AS p FROM c""")
def fixed_tau(spark, sf_dir):
    on = F.col("score") > -2.0
    edits = gating.gate(F.col("c_source"), F.col("c_hyp"), F.col("score"), -2.0, strict=True)
    c = facts(spark, sf_dir).agg(F.count_if(on & (F.col("c_hyp") < F.col("c_source"))).alias("better"), F.count_if(on & (F.col("c_hyp") > F.col("c_source"))).alias("worse"), r6(100 * F.avg(on.cast("int"))).alias("coverage"), r6(F.sum(edits) / F.sum("r_len")).alias("cer"))
    return c.withColumn("p", r6(binomial_p(F.least("better", "worse"), F.col("better") + F.col("worse"))))


@query(f"""WITH {FACTS} SELECT round(sum(least(c_hyp, c_source))::DOUBLE / sum(r_len), 6) AS cer_oracle, round((sum(c_hyp) - sum(least(c_hyp, c_source)))::DOUBLE / sum(r_len), 6) AS headroom, round(100 * avg((cer_hyp < cer_source)::INT), 6) AS hyp_better_percent FROM f""")
def oracle_gate(spark, sf_dir):
    best = F.when(F.col("cer_hyp") <= F.col("cer_source"), F.col("c_hyp")).otherwise(F.col("c_source"))
    return facts(spark, sf_dir).agg(r6(F.sum(best) / F.sum("r_len")).alias("cer_oracle"), r6((F.sum("c_hyp") - F.sum(best)) / F.sum("r_len")).alias("headroom"), r6(100 * F.avg((F.col("cer_hyp") < F.col("cer_source")).cast("int"))).alias("hyp_better_percent"))


@query(f"""WITH q AS (SELECT id, source AS s0, coalesce(source, '') AS s, coalesce(hyp, '') AS h, coalesce(gec_score, -99.0) AS score FROM {PRED})
SELECT id, CASE WHEN score >= -3.0 AND {char_distance('s', 'h')} / greatest(length(s), 1)::DOUBLE <= 0.2 THEN h ELSE s END AS kept FROM q""")
def guarded_gate(spark, sf_dir):
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = predictions(spark, sf_dir).select("id", text("source").alias("s"), text("hyp").alias("h"), gating.score(F.col("gec_score")).alias("score"))
    return rows.select("id", gating.gate(F.col("s"), gating.guarded(F.col("s"), F.col("h"), 0.2), F.col("score"), -3.0).alias("kept"))


@query(f"""WITH {FACTS}, {TAUS}, w AS (SELECT q, tau, sum(CASE WHEN score >= tau THEN c_hyp ELSE c_source END)::DOUBLE / sum(r_len) AS cer FROM taus, f GROUP BY 1, 2), n AS (SELECT sum(c_source)::DOUBLE / sum(r_len) AS c FROM f),
b AS (SELECT arg_min(q, (cer, q)) AS q, arg_min(tau, (cer, q)) AS tau, min(cer) AS cer FROM w) SELECT CASE WHEN cer < c THEN q END AS q, round(CASE WHEN cer < c THEN tau END, 6) AS tau, round(least(cer, c), 6) AS cer FROM b, n""")
def best_threshold(spark, sf_dir):
    """The first threshold that beats no correction at all."""
    rows = checkpointed(facts(spark, sf_dir).select("score", "c_source", "c_hyp", "r_len"))
    base = rows.agg((F.sum("c_source") / F.sum("r_len")).alias("c")).first().c
    out = gating.best(gating.sweep(rows, "score", "c_source", "c_hyp", "r_len", gating.thresholds(rows, "score")), F.lit(base))
    return out.select(F.col("q").cast("long").alias("q"), r6("tau").alias("tau"), r6("cer").alias("cer"))


# Layers, rates of empty references, matches


@query(f"""WITH {FACTS} SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS n, round({over('sum(c_hyp)', 'sum(r_len)')}, 6) AS cer, round({over('sum(w_hyp)', 'sum(r_words)')}, 6) AS wer,
round({over('sum(c_hyp)', 'sum(r_len)')}, 6) AS main FROM f {SETS}""")
def layer_recognition(spark, sf_dir):
    out = scoring.evaluated(facts(spark, sf_dir), "L1")
    return out.select("category", "n", r6("CER").alias("cer"), r6("WER").alias("wer"), r6("primary").alias("main"))


@query(f"""WITH t AS (SELECT {GROUP} AS category, {token_list('source')} AS s, {token_list('hyp')} AS h, {token_list('kalimat_koreksi')} AS r FROM {PRED}),
k AS (SELECT category, {KIND} AS k FROM t), c AS (SELECT category, len(list_filter(k, lambda x: x = 'tp')) AS tp, len(list_filter(k, lambda x: x = 'fp')) AS fp, len(list_filter(k, lambda x: x = 'fn')) AS fn FROM k),
m AS (SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS n, {prf('sum(tp)', 'sum(fp)', 'sum(fn)')} FROM c {SETS}) SELECT category, n, p, r, f05 AS main FROM m""")
def layer_normalisation(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(F.coalesce(F.upper(T.squeeze(F.col("category"))), F.lit("?")).alias("category"), scoring.token_counts(F.col("source"), F.col("hyp"), F.col("kalimat_koreksi")).alias("c")).select("category", "c.*")
    return scoring.evaluated(rows, "L2").select("category", "n", r6("P").alias("p"), r6("R").alias("r"), r6("primary").alias("main"))


@query(f"""WITH q AS (SELECT id, {nopunct('hyp')} AS h, {nopunct('kalimat_koreksi')} AS r FROM {PRED}), d AS (SELECT *, levenshtein(h, r) AS e FROM q)
SELECT id, round(CASE WHEN length(r) = 0 THEN (h <> '')::INT ELSE e / length(r)::DOUBLE END, 6) AS one, round(CASE WHEN length(r) = 0 THEN 0 ELSE e / length(r)::DOUBLE END, 6) AS zero, round(e / greatest(length(r), 1)::DOUBLE, 6) AS edits FROM d""")
def empty_reference_rates(spark, sf_dir):
    """Error rates under each rule for empty references."""
    rows = predictions(spark, sf_dir).select("id", T.normal(F.col("hyp"), "lower_nopunct").alias("h"), T.normal(F.col("kalimat_koreksi"), "lower_nopunct").alias("r")).withColumn("e", T.char_edits(F.col("h"), F.col("r")))
    return rows.select("id", *(r6(T.rate(F.col("e"), F.length("r"), F.col("h"), k).cast("double")).alias(k) for k in ("one", "zero", "edits")))


_BARE = lambda x: f"lower(regexp_replace({x}, '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g'))"
_CORE = lambda x: f"lower(regexp_replace({x}, '^[[:punct:]]+|[[:punct:]]+$', '', 'g'))"


@query(f"SELECT id, {_BARE('hyp')} = {_BARE('kalimat_koreksi')} AS exact, {_CORE('hyp')} = {_CORE('kalimat_koreksi')} AS same_core FROM {PRED}")
def exact_matches(spark, sf_dir):
    """Hypotheses equal to their correction but for case and outer white space, and but for case and outer marks."""
    h, r = F.col("hyp"), F.col("kalimat_koreksi")
    return predictions(spark, sf_dir).select("id", T.exact_match(h, r).alias("exact"), T.same_core(h, r).alias("same_core"))


@query(f"WITH {LEX}, {RUL} SELECT 'lexicon' AS resource, count(*) AS entries, sum(octet_length(encode(w)))::BIGINT AS bytes FROM lex UNION ALL SELECT 'rules', count(*), sum(octet_length(encode(variant)) + octet_length(encode(target)))::BIGINT FROM rul")
def resource_sizes(spark, sf_dir):
    """Entries and bytes of what the normaliser rests on; the bench times it."""
    words, rules = words_and_rules(spark, sf_dir)
    size = lambda *cs: F.coalesce(F.sum(sum((F.octet_length(c) for c in cs), start=F.lit(0))), F.lit(0)).cast("long").alias("bytes")
    return words.agg(F.lit("lexicon").alias("resource"), F.count("*").alias("entries"), size("w")).union(rules.agg(F.lit("rules"), F.count("*"), size("variant", "target")))
