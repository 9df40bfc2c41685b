"""Queries: scans, sampling, checks, cleaning, dataset preparation, corruption, streaming."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurus.functions import text as T
from lurus.operators import align, corrupt, dataset, plugins, quality, resources, sampling, synthetic
from lurus.plans.evaluation import NORM_TEXT, PRED, RUL, ocr, predictions
from lurus.plans.indexing import row_index
from lurus.plans.registry import Registry, draw, over, squeezed, token_list
from lurus.plans.session import checkpointed, scratch, table
from lurus.sources import readers, sinks
from lurus.streaming.normalize import normalize_stream

query = Registry()
CODE = f"coalesce(upper(substr({squeezed('category')}, 1, 3)), '?')"
KEY = lambda x: squeezed(f"lower({x})")
MD5 = lambda *c: f"md5(concat_ws('|', {', '.join(c)}))"


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "syn_metadata").select("image_id", "image_path", "src_text", "trg_text", "category", "augmentation_intensity", "split", "origin")


def coded(df: DataFrame) -> DataFrame:
    return df.withColumn("category", F.coalesce(dataset.code3(T.squeeze(F.col("category"))), F.lit("?")))


META = f"(SELECT image_id, image_path, src_text, trg_text, {CODE} AS category, augmentation_intensity, split FROM syn_metadata)"

# Scans: each writes a table by a sink and reads it back by the reader of that format.

TEXT_ROWS = "SELECT id, category, coalesce(source, '') AS source, coalesce(hyp, '') AS hyp, gec_score FROM " + PRED.replace("DISTINCT id", "DISTINCT id::BIGINT AS id")
TEXT_SCHEMA = "id long, category string, source string, hyp string, gec_score double"


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select(F.col("id").cast("long").alias("id"), "category", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("hyp", F.lit("")).alias("hyp"), "gec_score")


def _delimited(spark, sf_dir, ending: str, sep: str) -> DataFrame:
    sinks.delimited(text_rows(spark, sf_dir), path := scratch(spark, "scan") + ending, sep)
    out = readers.delimited(spark, path, TEXT_SCHEMA)
    return out.select("id", "category", *(F.coalesce(c, F.lit("")).alias(c) for c in ("source", "hyp")), "gec_score")


@query(TEXT_ROWS)
def scan_csv(spark, sf_dir):
    return _delimited(spark, sf_dir, ".csv", ",")


@query(TEXT_ROWS)
def scan_tsv(spark, sf_dir):
    return _delimited(spark, sf_dir, ".tsv", "\t")


@query(TEXT_ROWS)
def scan_json_lines(spark, sf_dir):
    sinks.json_lines(text_rows(spark, sf_dir), path := scratch(spark, "scan"))
    return readers.json_lines(spark, path, TEXT_SCHEMA)


@query("SELECT rule_id::BIGINT AS rule_id, formal, variant FROM algospeak_dict")
def scan_json_document(spark, sf_dir):
    rows = table(spark, sf_dir, "algospeak_dict").select("rule_id", "formal", "variant")
    one = rows.agg(F.to_json(F.struct(F.lit("rules").alias("kind"), F.collect_list(F.struct(*rows.columns)).alias("items"))).alias("value"))
    one.coalesce(1).write.text(path := scratch(spark, "document"))
    return readers.json_document(spark, path, "rule_id:long,formal:string,variant:string")


FLAT = """WITH r AS (SELECT DISTINCT ann_id, filename, sentences FROM annotations), s AS (SELECT ann_id, unnest(CASE WHEN len(sentences) > 0 THEN sentences ELSE [NULL] END) AS s, CASE WHEN len(sentences) > 0 THEN unnest(range(len(sentences))) END AS sentence_pos FROM r)
SELECT ann_id, sentence_pos::BIGINT AS sentence_pos, s.sentence_id AS sentence_id, e.token_salah AS token_salah, e.token_benar AS token_benar FROM (SELECT ann_id, sentence_pos, s, unnest(CASE WHEN len(s.errors) > 0 THEN s.errors ELSE [NULL] END) AS e FROM s)"""


@query(FLAT)
def flatten_annotations(spark, sf_dir):
    rows = table(spark, sf_dir, "annotations").select("ann_id", "filename", "primary_category", "sentences").distinct()
    flat = readers.flattened(rows.withColumn("filename", F.col("ann_id").cast("string")))
    return flat.select(F.col("filename").cast("long").alias("ann_id"), F.col("sentence_pos").cast("long").alias("sentence_pos"), "sentence_id", "token_salah", "token_benar")


LINES = "regexp_replace(coalesce({0}, ''), '[\\r\\n]+', ' ', 'g')"


@query(f"SELECT row_number() OVER (ORDER BY id) - 1 AS line_no, {LINES.format('source')} AS src, {LINES.format('kalimat_koreksi')} AS tgt FROM {PRED}")
def scan_aligned(spark, sf_dir):
    path = scratch(spark, "pairs")
    rows = predictions(spark, sf_dir).select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("source", "kalimat_koreksi")))
    sinks.parallel(rows, "id", "source", "kalimat_koreksi", path)
    return readers.aligned(spark, path + ".src", path + ".tgt")


@query("SELECT w, f::INTEGER AS f FROM lexicon WHERE w IS NOT NULL AND f IS NOT NULL AND NOT regexp_matches(trim(w), '\\s') AND trim(w) <> ''".replace("SELECT w,", "SELECT trim(w) AS w,"))
def scan_word_list(spark, sf_dir):
    rows = table(spark, sf_dir, "lexicon").where(r"w is not null and f is not null and not trim(w) rlike '\\s' and trim(w) <> ''")
    rows.select(F.concat_ws(" ", "w", "f").alias("value")).write.text(path := scratch(spark, "words"))
    return readers.word_frequencies(spark, path)


@query(f"SELECT DISTINCT CASE WHEN section IN {readers.SECTIONS} THEN section ELSE 'combined_rules' END AS section, formal, variant FROM algospeak_dict WHERE formal IS NOT NULL AND variant IS NOT NULL")
def scan_rules(spark, sf_dir):
    """Rules through the dictionary's JSON form: sections that map a word to one or to several variants, and a list of rules for all others."""
    rows = table(spark, sf_dir, "algospeak_dict").where("formal is not null and variant is not null").select("section", "formal", "variant").distinct().orderBy("section", "formal", "variant").collect()  # a fixed, small table
    document: dict = {"combined_rules": []}
    for r in rows:
        if r.section in readers.SECTIONS:
            document.setdefault(r.section, {}).setdefault(r.formal, []).append(r.variant)
        else:
            document["combined_rules"].append({"from": r.formal, "to": r.variant})
    for section in readers.SECTIONS:
        document[section] = {k: v if len(v) > 1 else v[0] for k, v in document.get(section, {}).items()}
    return readers.rules(spark, json.dumps(document)).distinct()


@query(f"SELECT id, round(coalesce(gec_score, -99.0), 6) AS score, regexp_replace(coalesce(hyp, ''), '[\\t\\r\\n]+', ' ', 'g') AS text FROM {PRED}")
def scan_generated(spark, sf_dir):
    clean = F.regexp_replace(F.coalesce("hyp", F.lit("")), "[\t\r\n]+", " ")
    line = F.concat_ws("\t", F.concat(F.lit("H-"), "id"), F.coalesce("gec_score", F.lit(-99.0)), clean)
    predictions(spark, sf_dir).select(F.explode(F.array(line, F.concat(F.lit("S-"), "id"))).alias("value")).write.text(path := scratch(spark, "generated"))
    return readers.generated(spark, path).withColumn("score", F.round("score", 6))


@query("SELECT DISTINCT string_split(trim(w), ' ')[1] AS token FROM lexicon WHERE trim(w) <> ''")
def scan_first_tokens(spark, sf_dir):
    table(spark, sf_dir, "lexicon").where("w is not null").select(F.concat_ws(" ", "w", F.lit(1)).alias("value")).write.text(path := scratch(spark, "dict"))
    return readers.first_tokens(spark, path)


@query(f"SELECT id::BIGINT AS id, coalesce(hyp, '') AS hyp, '{chr(45)}' AS ocr_hyp FROM {PRED}")
def resolve_columns(spark, sf_dir):
    rows = predictions(spark, sf_dir).select(F.col("id").cast("long").alias("ID"), F.coalesce("hyp", F.lit("")).alias("Prediction"))
    return readers.resolved(rows.withColumn("ID", F.col("ID").cast("string")), {"id": (), "hyp": ("prediction",), "ocr_hyp": ()}, "-").withColumn("id", F.col("id").cast("long"))


# Sampling

PLACE = f"(SELECT *, {draw('42', 'image_id')} AS p FROM {META})"


@query(f"""WITH r AS (SELECT image_id, category, row_number() OVER (PARTITION BY category ORDER BY p, image_id) AS k, count(*) OVER (PARTITION BY category) AS n FROM {PLACE})
SELECT image_id, category, CASE WHEN k <= greatest(1, floor(n * 0.1)) THEN 'val' WHEN k <= greatest(1, floor(n * 0.1)) + greatest(1, floor(n * 0.1)) THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(coded(metadata(spark, sf_dir)).select("image_id", "category"), "category", "image_id").select("image_id", "category", "part")


@query(f"SELECT image_id, category FROM {META} QUALIFY row_number() OVER (PARTITION BY category ORDER BY {MD5('42', 'image_id')}, image_id) <= 20")
def stratified_sample(spark, sf_dir):
    return sampling.sample_per_group(coded(metadata(spark, sf_dir)).select("image_id", "category"), "category", "image_id", 20)


WEIGHTS = {"EJA": 0.4, "TIP": 0.25, "ALG": 0.2, "MOR": 0.15}
WEIGHT_ROWS = ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "category string, weight double")


@query(f"WITH w(category, weight) AS (VALUES {WEIGHT_ROWS}), b AS (SELECT category, floor(weight::DOUBLE * 997)::BIGINT AS b FROM w) SELECT category, b + CASE WHEN category = (SELECT min(category) FROM b) THEN 997 - (SELECT sum(b) FROM b)::BIGINT ELSE 0 END AS budget FROM b")
def budget_allocation(spark, sf_dir):
    return sampling.budget(weights(spark), "category", "weight", 997)


@query(f"WITH b(category, budget) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {int(v * 100)})' for k, v in WEIGHTS.items())}) SELECT image_id, category FROM {META} JOIN b USING (category) WHERE coalesce(trim(src_text) <> trim(trg_text), false) QUALIFY row_number() OVER (PARTITION BY category ORDER BY {MD5('42', 'image_id')}, image_id) <= budget")
def take_until_budget(spark, sf_dir):
    budgets = sampling.budget(weights(spark), "category", "weight", 100, remainder_to_first=False)
    rows = coded(metadata(spark, sf_dir)).select("image_id", "category", "src_text", "trg_text")
    return sampling.take_budget(rows, "category", budgets, "image_id", F.coalesce(F.trim("src_text") != F.trim("trg_text"), F.lit(False))).select("image_id", "category")


@query(f"WITH x AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS i FROM {META}) SELECT k, image_id FROM (SELECT k, {draw('42', 'k')} % (SELECT count(*) FROM x) AS i FROM range(500) t(k)) JOIN x USING (i)")
def sample_with_replacement(spark, sf_dir):
    return sampling.with_replacement(metadata(spark, sf_dir).select("image_id"), "image_id", 500)


@query(f"SELECT image_id FROM {META} QUALIFY row_number() OVER (PARTITION BY {KEY('trg_text')} ORDER BY {MD5('42', 'image_id')}, image_id) = 1")
def dedup_first(spark, sf_dir):
    return sampling.first_of_key(metadata(spark, sf_dir).select("image_id", "trg_text"), "trg_text", "image_id").select("image_id")


@query(f"SELECT image_id FROM {META} m WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {KEY('kalimat_koreksi')} AS k FROM predictions) u WHERE u.k = {KEY('m.trg_text')})")
def held_out(spark, sf_dir):
    return sampling.unused(metadata(spark, sf_dir).select("image_id", "trg_text"), "trg_text", table(spark, sf_dir, "predictions"), "kalimat_koreksi").select("image_id")


@query(f"SELECT image_id, row_number() OVER (ORDER BY {MD5('42', 'image_id')}, image_id) AS place FROM {META}")
def global_shuffle(spark, sf_dir):
    rows = metadata(spark, sf_dir).select("image_id", sampling.hashed(42, "image_id").alias("key"))
    return row_index(rows, "key", "image_id").select("image_id", (F.col("i") + 1).alias("place"))


# Checks and cleaning


@query(f"""WITH e(category, expected) AS (VALUES {WEIGHT_ROWS}), h AS (SELECT category, count(*) AS n FROM {META} GROUP BY 1), t AS (SELECT count(*) AS n_all FROM syn_metadata)
SELECT category, coalesce(n, 0) AS n, round(coalesce(n, 0) / n_all::DOUBLE, 6) AS share, coalesce(expected::DOUBLE, 0.0) AS expected, abs(coalesce(n, 0) / n_all::DOUBLE - coalesce(expected::DOUBLE, 0)) <= 0.05 AS ok FROM h FULL JOIN e USING (category), t""")
def category_share(spark, sf_dir):
    return quality.shares(coded(metadata(spark, sf_dir)), "category", weights(spark), "weight").withColumn("share", F.round("share", 6))


@query(f"""SELECT category, count(src_text) AS n, round(avg(length(src_text)), 6) AS mean_len, round(median(length(src_text)), 6) AS median_len, min(length(src_text)) AS min_len, max(length(src_text)) AS max_len,
count(*) FILTER ({squeezed('src_text')} = '') AS empty, round({over('count(*) FILTER (length(src_text) BETWEEN 90 AND 130)', 'count(src_text)')}, 6) AS in_range FROM {META} GROUP BY 1""")
def length_stats(spark, sf_dir):
    out = coded(metadata(spark, sf_dir)).groupBy("category").agg(*quality.length_stats("src_text", 90, 130))
    return out.select("category", "n", F.round("mean_len", 6).alias("mean_len"), F.round("median_len", 6).alias("median_len"), F.col("min_len").cast("long").alias("min_len"), F.col("max_len").cast("long").alias("max_len"), "empty", F.round("in_range", 6).alias("in_range"))


@query("SELECT count(*) AS n, count(DISTINCT (src_text, trg_text)) AS n_distinct, round(1 - count(DISTINCT (src_text, trg_text))::DOUBLE / count(*), 6) AS dup_rate FROM syn_metadata")
def duplicate_rate(spark, sf_dir):
    return metadata(spark, sf_dir).agg(*quality.duplicate_rate("src_text", "trg_text")).withColumn("dup_rate", F.round("dup_rate", 6))


BARE = lambda x: f"regexp_replace({x}, '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g')"
SAME = f"coalesce({BARE('src_text')} = {BARE('trg_text')}, false)"
KEEP = f"(NOT {SAME} AND {squeezed(chr(99) + 'oalesce(src_text, ' + chr(39) * 2 + ')')} <> '' AND {squeezed('coalesce(trg_text, ' + chr(39) * 2 + ')')} <> '')"


@query(f"SELECT category, round(avg({SAME}::INT), 6) AS identical_rate, avg({SAME}::INT) > 0.02 AS flagged FROM {META} GROUP BY 1")
def identical_rate(spark, sf_dir):
    rate = F.avg(quality.identical("src_text", "trg_text").cast("int"))
    return coded(metadata(spark, sf_dir)).groupBy("category").agg(F.round(rate, 6).alias("identical_rate"), (rate > 0.02).alias("flagged"))


@query(f"SELECT category, count(*) AS before, count(*) FILTER (NOT {KEEP}) AS removed, count(*) FILTER ({KEEP}) AS after FROM {META} GROUP BY 1")
def clean_counts(spark, sf_dir):
    return quality.clean_counts(coded(metadata(spark, sf_dir)), "category", "src_text", "trg_text")


@query(f"SELECT image_id FROM {META} WHERE {KEEP}")
def cleaned(spark, sf_dir):
    return quality.clean(metadata(spark, sf_dir), "src_text", "trg_text").select("image_id")


@query(f"SELECT category, image_id FROM {META} WHERE NOT {KEEP} QUALIFY row_number() OVER (PARTITION BY category ORDER BY image_id) <= 3")
def first_removed(spark, sf_dir):
    from pyspark.sql import Window

    rows = coded(metadata(spark, sf_dir)).select("category", "image_id", "src_text", "trg_text")
    removed = rows.join(quality.clean(rows, "src_text", "trg_text").select("image_id"), "image_id", "left_anti")
    return removed.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("image_id"))).where("k <= 3").select("category", "image_id")


@query("SELECT category, count(*) AS n FROM syn_metadata WHERE category IS NOT NULL AND category NOT IN ('spelling', 'typographic', 'algospeak', 'morphological', 'semantic', 'syntactic', 'mixed') GROUP BY 1")
def unknown_categories(spark, sf_dir):
    known = spark.createDataFrame([(c,) for c in ("spelling", "typographic", "algospeak", "morphological", "semantic", "syntactic", "mixed")], "category string")
    return metadata(spark, sf_dir).where("category is not null").groupBy("category").agg(F.count("*").alias("n")).join(F.broadcast(known), "category", "left_anti")


@query(f"SELECT lower({squeezed('split')}) AS split, category, count(*) AS n FROM {META} GROUP BY 1, 2")
def split_category(spark, sf_dir):
    return coded(metadata(spark, sf_dir)).groupBy(F.lower(T.squeeze(F.col("split"))).alias("split"), "category").agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(lower({squeezed('augmentation_intensity')}), 'missing') AS intensity, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM syn_metadata), 6) AS share FROM syn_metadata GROUP BY 1")
def augmentation_share(spark, sf_dir):
    rows = metadata(spark, sf_dir)
    total = F.broadcast(rows.agg(F.count("*").alias("all")))
    counts = rows.groupBy(F.coalesce(F.lower(T.squeeze(F.col("augmentation_intensity"))), F.lit("missing")).alias("intensity")).agg(F.count("*").alias("n"))
    return counts.join(total).select("intensity", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


CHECKS = """WITH m AS (SELECT avg((src_text IS NULL OR trg_text IS NULL)::INT) AS missing, 1 - count(DISTINCT (src_text, trg_text))::DOUBLE / count(*) AS duplicates, avg({same}::INT) AS identical FROM syn_metadata),
c AS (SELECT 'missing' AS check_name, missing AS value, 0.01 AS a, 0.05 AS b FROM m UNION ALL SELECT 'duplicates', duplicates, 0.01, 0.05 FROM m UNION ALL SELECT 'identical', identical, 0.02, 0.1 FROM m)
SELECT check_name, round(value, 6) AS value, CASE WHEN value IS NULL THEN 'skip' WHEN value <= a THEN 'pass' WHEN value <= b THEN 'warn' ELSE 'fail' END AS status FROM c"""


@query(CHECKS.format(same=SAME))
def checks_summary(spark, sf_dir):
    rules = {
        "missing": (F.avg((F.col("src_text").isNull() | F.col("trg_text").isNull()).cast("int")), 0.01, 0.05),
        "duplicates": (quality.duplicate_rate("src_text", "trg_text")[2], 0.01, 0.05),
        "identical": (F.avg(quality.identical("src_text", "trg_text").cast("int")), 0.02, 0.1),
    }
    return quality.checks(metadata(spark, sf_dir), rules).withColumn("value", F.round("value", 6))


@query("SELECT image_id, (len(list_filter(range(1, least(length(src_text), length(trg_text)) + 1), lambda i: src_text[i] <> trg_text[i])) + abs(length(src_text) - length(trg_text)))::BIGINT AS differing FROM syn_metadata WHERE src_text IS NOT NULL AND trg_text IS NOT NULL")
def char_differences(spark, sf_dir):
    rows = metadata(spark, sf_dir).where("src_text is not null and trg_text is not null")
    return rows.select("image_id", T.differing_chars(F.col("src_text"), F.col("trg_text")).cast("long").alias("differing"))


@query("""WITH f AS (SELECT DISTINCT filename, primary_category FROM annotations WHERE filename IS NOT NULL), c AS (SELECT DISTINCT regexp_extract(crop, '([^/]+?)(_[^_/.]*)?(\\.[^./]*)?$', 1) AS stem FROM ocr_outputs),
n AS (SELECT coalesce(primary_category, '?') AS name, count(*) AS n FROM f GROUP BY 1)
SELECT count(*) AS n, 0::BIGINT AS missing, 0::BIGINT AS empty, min(octet_length(encode(name || ' ' || n)))::BIGINT AS min_size, max(octet_length(encode(name || ' ' || n)))::BIGINT AS max_size FROM n""")
def file_integrity(spark, sf_dir):
    """Files written for each category of the annotations, read again and held against their list."""
    f = table(spark, sf_dir, "annotations").where("filename is not null").select("filename", "primary_category").distinct()
    counts = f.groupBy(F.coalesce("primary_category", F.lit("?")).alias("name")).agg(F.count("*").alias("n"))
    rows = row_index(counts, "name", name="id").select("id", F.encode(F.concat_ws(" ", "name", "n"), "UTF-8").alias("content"))
    folder = scratch(spark, "files").removeprefix("file:")
    listed = checkpointed(sinks.files(rows, "id", "content", folder, "txt"))
    return quality.file_integrity(listed.select(F.concat(F.lit("files/"), "name").alias("path")), "path", readers.images(spark, folder)).select("n", "missing", "empty", "min_size", "max_size")


@query(f"""SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(src_text) AS n, round(avg(length(src_text)), 6) AS mean_len, round(median(length(src_text)), 6) AS median_len, min(length(src_text)) AS min_len, max(length(src_text)) AS max_len FROM {META} GROUP BY GROUPING SETS ((category), ())""")
def length_stats_all(spark, sf_dir):
    """Lengths of each category and of all rows."""
    rows = coded(metadata(spark, sf_dir))
    stats = rows.groupingSets([[F.col("category")], []], F.col("category")).agg(F.grouping("category").alias("g"), *quality.length_stats("src_text", 90, 130))
    return stats.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("category")).alias("category"), "n", F.round("mean_len", 6).alias("mean_len"), F.round("median_len", 6).alias("median_len"), F.col("min_len").cast("long").alias("min_len"), F.col("max_len").cast("long").alias("max_len"))


NEEDED = {"image_id": ("id",), "src_text": ("source",), "trg_text": ("target",), "category": (), "split": (), "checksum": ()}


@query("SELECT * FROM (VALUES ('missing', 'checksum'), ('extra', 'image_path'), ('extra', 'augmentation_intensity'), ('extra', 'origin')) t(kind, name)")
def columns_check(spark, sf_dir):
    """Needed columns that the corpus lacks, and those that nobody asked for."""
    rows = metadata(spark, sf_dir)
    found = [("missing", c) for c in quality.columns_missing(rows, NEEDED)] + [("extra", c) for c in quality.columns_extra(rows, NEEDED)]
    return spark.createDataFrame(found, "kind string, name string")


@query(f"SELECT image_id, category FROM {META} WHERE category IN ('EJA', 'TIP', 'SPE', 'TYP')")
def category_rows(spark, sf_dir):
    return dataset.in_categories(coded(metadata(spark, sf_dir)), "category", ("EJA", "TIP", "SPE", "TYP")).select("image_id", "category")


@query(f"""WITH n AS (SELECT {CODE} AS category, count(*) AS n FROM syn_metadata GROUP BY 1) SELECT category, format('{{:,.1f}}', n * 1000 / 1e6) || ' MB' AS size, format('{{:,.1f}}', 100 * n / sum(n) OVER ()) || ' %' AS share,
repeat('█', round(n * 40 / sum(n) OVER ())::INT) AS bar FROM n""")
def share_report(spark, sf_dir):
    """Categories as a report shows them: at 1,000 bytes a row."""
    rows = coded(metadata(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))
    total = F.broadcast(rows.agg(F.sum("n").alias("all")))  # one row
    share = F.col("n") / F.col("all")
    return rows.join(total).select("category", T.megabytes(F.col("n") * 1000).alias("size"), T.percent(share).alias("share"), T.bar(share).alias("bar"))


@query(TEXT_ROWS)
def scan_bad_lines(spark, sf_dir):
    """A CSV with lines of too few and of too many fields, which the scan drops."""
    path = scratch(spark, "bad") + ".csv"
    sinks.delimited(text_rows(spark, sf_dir), path)
    spark.createDataFrame([("id,category,source,hyp,gec_score\nx\n1,a,b,c,d,e,f\nnot a number,a,b,c,0.5",)], "value string").coalesce(1).write.mode("append").text(path)
    out = readers.delimited(spark, path, TEXT_SCHEMA, drop_bad=True)
    return out.select("id", "category", *(F.coalesce(c, F.lit("")).alias(c) for c in ("source", "hyp")), "gec_score")


@query(f"SELECT 'a' AS run_id, {CODE} AS category, count(*) AS n FROM {PRED} GROUP BY 2 UNION ALL SELECT 'b', {CODE}, count(*) FROM ocr_outputs GROUP BY 2")
def csv_runs(spark, sf_dir):
    """Two runs added to one CSV folder, one of them twice."""
    path = scratch(spark, "runs")
    count = lambda df: coded(df).groupBy("category").agg(F.count("*").alias("n"))
    for run, rows in (("a", predictions(spark, sf_dir)), ("b", table(spark, sf_dir, "ocr_outputs")), ("a", predictions(spark, sf_dir))):
        sinks.run_csv(count(rows), path, run)
    return spark.read.schema("category string, n long, run_id string").option("header", True).csv(path).select("run_id", "category", "n")


@query(f"SELECT image_id, coalesce(length(src_text), 0)::BIGINT AS letters FROM {META}")
def resumed_rows(spark, sf_dir):
    """A job that was broken off after the evaluation splits, gone on with."""
    rows, path = metadata(spark, sf_dir).select("image_id", "src_text", "split"), scratch(spark, "resumed")
    make = lambda df: df.select("image_id", F.coalesce(F.length("src_text"), F.lit(0)).cast("long").alias("letters"))
    sinks.resumed(rows.where(~dataset.in_split(F.col("split"), "train")), path, "image_id", make)
    sinks.resumed(rows, path, "image_id", make)
    return spark.read.parquet(path)


# Dataset preparation

TAG = f"CASE WHEN c IN ('ALG', 'SEM', 'ALGOSPEAK', 'SEMANTIC') THEN '<semantic>' WHEN c IN ('SIN', 'SYNTACTIC') THEN '<syntactic>' ELSE '<morphological>' END"


@query(f"SELECT image_id, {TAG} AS tag FROM (SELECT image_id, upper({squeezed('category')}) AS c FROM syn_metadata)")
def category_tags(spark, sf_dir):
    return metadata(spark, sf_dir).select("image_id", dataset.tag(F.col("category")).alias("tag"))


@query(f"SELECT image_id, CASE WHEN src_text IS NOT NULL THEN substr({TAG}, 2, length({TAG}) - 2) END AS tag_name, src_text AS text FROM (SELECT image_id, regexp_replace(src_text, '^[ \\t\\n\\x0B\\f\\r]+', '') AS src_text, upper({squeezed('category')}) AS c FROM syn_metadata)")
def tag_round_trip(spark, sf_dir):
    rows = metadata(spark, sf_dir).select("image_id", F.regexp_replace("src_text", r"^[ \t\n\x0B\f\r]+", "").alias("src_text"), dataset.tag(F.col("category")).alias("tag"))
    tagged = rows.select("image_id", dataset.with_tag(F.col("src_text"), F.col("tag")).alias("t"))
    return tagged.select("image_id", dataset.tag_of(F.col("t")).alias("tag_name"), dataset.without_tag(F.col("t")).alias("text"))


@query(f"""WITH s AS (SELECT ann_id, primary_category, unnest(sentences) AS s, unnest(range(len(sentences))) AS pos FROM (SELECT DISTINCT ann_id, primary_category, sentences FROM annotations)),
c AS (SELECT ann_id, pos, upper({squeezed('primary_category')}) AS fb, list_filter(list_transform(s.errors, lambda e: upper(e.category)), lambda x: x <> '') AS cs FROM s WHERE s IS NOT NULL),
m AS (SELECT ann_id, pos, fb, list_transform(list_distinct(cs), lambda v: {{'n': len(list_filter(cs, lambda x: x = v)), 'f': -list_position(cs, v), 'v': v}}) AS l FROM c)
SELECT ann_id, pos::BIGINT AS sentence_pos, coalesce(list_reverse_sort(l)[1].v, fb) AS category FROM m""")
def majority_category(spark, sf_dir):
    rows = table(spark, sf_dir, "annotations").select("ann_id", "primary_category", "sentences").distinct().select("ann_id", "primary_category", F.posexplode("sentences").alias("pos", "s")).where("s is not null")
    codes = F.transform("s.errors", lambda e: F.upper(e["category"]))
    return rows.select("ann_id", F.col("pos").cast("long").alias("sentence_pos"), dataset.majority(codes, F.upper(T.squeeze(F.col("primary_category")))).alias("category"))


@query(f"SELECT crop_id, CASE WHEN {squeezed('coalesce(paddleocr_out, ' + chr(39) * 2 + ')')} <> '' THEN paddleocr_out ELSE teks_ocr END AS source FROM (SELECT DISTINCT crop_id, paddleocr_out, teks_ocr FROM ocr_outputs)")
def chosen_source(spark, sf_dir):
    rows = table(spark, sf_dir, "ocr_outputs").select("crop_id", "paddleocr_out", "teks_ocr").distinct()
    return rows.select("crop_id", dataset.chosen_source(F.col("paddleocr_out"), F.col("teks_ocr")).alias("source"))


VOCAB = f"""t AS (SELECT lower(unnest({token_list('source')})) AS token FROM {PRED} UNION ALL SELECT lower(unnest({token_list('kalimat_koreksi')})) FROM {PRED}),
c AS (SELECT token, count(*) AS n FROM t WHERE token NOT IN ('<pad>', '<unk>', '<s>', '</s>') GROUP BY 1 HAVING count(*) >= 2), vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM c)"""


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.vocabulary(predictions(spark, sf_dir), "source", "kalimat_koreksi", least=2)


@query(f"WITH {VOCAB} SELECT * FROM vocab")
def vocabulary(spark, sf_dir):
    return vocab(spark, sf_dir)


ENCODED = f"""{VOCAB}, e AS (SELECT id, list_slice({token_list('hyp')}, 1, 126) AS ts FROM {PRED}), x AS (SELECT id, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM e),
g AS (SELECT id, list(coalesce(token_id, 1) ORDER BY pos) AS p FROM x LEFT JOIN vocab ON lower(t) = token GROUP BY 1), ids AS (SELECT id, list_concat([2], coalesce(p, []), [3])::BIGINT[] AS ids FROM e LEFT JOIN g USING (id))"""


@query(f"WITH {ENCODED} SELECT id, ids FROM ids")
def encoded(spark, sf_dir):
    return dataset.encode(predictions(spark, sf_dir), "id", "hyp", checkpointed(vocab(spark, sf_dir)), bos=True, most=128)


@query(f"WITH {ENCODED}, u AS (SELECT id, unnest(ids) AS i, generate_subscripts(ids, 1) AS pos FROM ids), d AS (SELECT id, string_agg(token, ' ' ORDER BY pos) FILTER (i = 1 OR i >= 4) AS x FROM u LEFT JOIN vocab ON i = token_id GROUP BY 1) SELECT id, coalesce(x, '') AS text FROM d".replace("FILTER (i = 1 OR i >= 4)", "FILTER (i >= 4)"))
def decoded(spark, sf_dir):
    v = checkpointed(vocab(spark, sf_dir))
    return dataset.decode(dataset.encode(predictions(spark, sf_dir), "id", "hyp", v, bos=True, most=128), "id", "ids", v)


@query(f"WITH {ENCODED}, m AS (SELECT id, id // 32 AS batch, ids, max(len(ids)) OVER (PARTITION BY id // 32) AS l FROM ids) SELECT id, list_resize(ids, l, 0)::BIGINT[] AS padded, list_transform(range(1, l + 1), lambda i: (i <= len(ids))::INT) AS mask FROM m")
def padded_batches(spark, sf_dir):
    ids = dataset.encode(predictions(spark, sf_dir), "id", "hyp", checkpointed(vocab(spark, sf_dir)), bos=True, most=128)
    return dataset.padded(ids.withColumn("batch", F.expr("id div 32")), "ids", "batch").select("id", "padded", "mask")


@query(f"""WITH lex AS (SELECT DISTINCT lower({squeezed('w')}) AS token FROM lexicon WHERE w IS NOT NULL), c AS (SELECT token, count(*) AS n FROM (SELECT lower(unnest({token_list('kalimat_koreksi')})) AS token FROM {PRED}) GROUP BY 1)
SELECT token, n FROM c WHERE token NOT IN (SELECT token FROM lex) ORDER BY n DESC, token LIMIT 8""")
def unknown_top(spark, sf_dir):
    known = table(spark, sf_dir, "lexicon").select(F.lower(T.squeeze(F.col("w"))).alias("token")).where("token is not null")
    return dataset.unknown_tokens(predictions(spark, sf_dir), "kalimat_koreksi", known).orderBy(F.col("n").desc(), "token").limit(8)


@query(f"""WITH lex AS (SELECT DISTINCT lower({squeezed('w')}) AS token FROM lexicon WHERE w IS NOT NULL), c AS (SELECT token, count(*) AS n FROM (SELECT lower(unnest({token_list('kalimat_koreksi')})) AS token FROM {PRED}) GROUP BY 1)
SELECT sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (token NOT IN (SELECT token FROM lex)), 0)::BIGINT AS unknown, round({over('coalesce(sum(n) FILTER (token NOT IN (SELECT token FROM lex)), 0)', 'sum(n)')}, 6) AS rate FROM c""")
def unknown_rate(spark, sf_dir):
    """Share of tokens that the word list lacks."""
    known = table(spark, sf_dir, "lexicon").select(F.lower(T.squeeze(F.col("w"))).alias("token")).where("token is not null")
    return dataset.unknown_rate(predictions(spark, sf_dir), "kalimat_koreksi", known).withColumn("rate", F.round("rate", 6))


@query()
def word_pieces(spark, sf_dir):
    """Corrections cut into the longest pieces of a vocabulary: the word list's entries, its letters, and both as inner pieces."""
    words = [r.w for r in table(spark, sf_dir, "lexicon").select(F.lower(T.squeeze(F.col("w"))).alias("w")).where("w is not null").distinct().collect()]  # a fixed, small table
    pieces = {*words, *(c for w in words for c in w)}
    cut = align.greedy_pieces(frozenset(pieces | {"##" + x for x in pieces}))
    return predictions(spark, sf_dir).select("id", cut(F.lower("kalimat_koreksi")).alias("pieces"))


PIECES = "CASE WHEN length(t) > 5 THEN substr(t, 1, 4) || ' ##' || substr(t, 5) ELSE t END"


def _mended(x: str) -> str:
    sp = T.SPACE
    for a, b in ((f"[{sp}]+([,.!?;:])", "\\1"), (f"([(\\[{{])[{sp}]+", "\\1"), (f"[{sp}]+([)\\]}}])", "\\1"), (f"[{sp}]{{2,}}", " "), (f"^[{sp}]+|[{sp}]+$", "")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


def _generated(x: str) -> str:
    sp = T.SPACE
    for a, b in ((f"[{sp}]+([,.!?;:%)\\]}}»”’])", "\\1"), (f"([(\\[{{«“‘])[{sp}]+", "\\1"), (f"[{sp}]+([*''\"-])[{sp}]+", "\\1"), (f"[{sp}]{{2,}}", " "), (f"^[{sp}]+|[{sp}]+$", "")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


GLUED = f"array_to_string(list_filter({token_list('hyp')}, lambda t: t NOT IN ('[CLS]', '[SEP]')), ' ')"


@query(f"SELECT id, {_generated(f'regexp_replace(replace({GLUED}, {chr(39)} ##{chr(39)}, {chr(39) * 2}), {chr(39)}^##{chr(39)}, {chr(39) * 2})')} AS text FROM {PRED}")
def joined_pieces(spark, sf_dir):
    """Words cut into pieces and glued again, and the spacing around their marks mended."""
    ts = T.tokens(F.col("hyp"))
    pieces = F.transform(ts, lambda t: F.when(F.length(t) > 5, F.concat(F.substring(t, 1, 4), F.lit(" ##"), F.substr(t, F.lit(5)))).otherwise(t))
    return predictions(spark, sf_dir).select("id", T.join_pieces(F.concat(F.lit("[CLS] "), F.array_join(pieces, " "), F.lit(" [SEP]"))).alias("text"))


@query(f"SELECT id, {_mended('kalimat_koreksi')} AS text FROM {PRED}")
def mended_spacing(spark, sf_dir):
    return predictions(spark, sf_dir).select("id", T.mend_spacing(F.col("kalimat_koreksi")).alias("text"))


@query("SELECT crop_id, regexp_extract(crop, '([^/\\\\]+?)(\\.[^./\\\\]*)?$', 1) || '_' || ann_id::VARCHAR AS key FROM (SELECT DISTINCT crop_id, crop, ann_id FROM ocr_outputs)")
def stem_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "ocr_outputs").select("crop_id", "crop", "ann_id").distinct()
    return rows.select("crop_id", dataset.stem_key(F.col("crop"), F.col("ann_id")).alias("key"))


@query(f"SELECT category, count(*) AS n FROM (SELECT {CODE} AS category FROM {PRED} UNION ALL SELECT category FROM (SELECT category FROM {META} ORDER BY image_id LIMIT 3000)) GROUP BY 1".replace(" ORDER BY image_id LIMIT 3000", ""))
def union_real_synthetic(spark, sf_dir):
    rows = coded(predictions(spark, sf_dir)).select("category").unionByName(coded(metadata(spark, sf_dir)).select("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


# Corruption

INJECT = f"""inj AS (SELECT formal, list_sort(list(DISTINCT variant)) AS vs FROM (SELECT lower({squeezed('formal')}) AS formal, {squeezed('variant')} AS variant FROM algospeak_dict) WHERE formal <> '' AND variant <> '' GROUP BY 1),
b AS (SELECT image_id AS id, trg_text AS t, {token_list('trg_text')} AS ts FROM syn_metadata), fl AS (SELECT id, unnest(ts) AS w, generate_subscripts(ts, 1) - 1 AS pos FROM b),
hit AS (SELECT id, pos, vs[1 + {draw('42', 'id', 'pos', "'v'")} % len(vs)] || regexp_extract(w, '([.,!?;:])$', 1) AS new FROM fl JOIN inj ON formal = regexp_replace(lower(w), '[.,!?;:]+$', '') QUALIFY row_number() OVER (PARTITION BY id ORDER BY {draw('42', 'id', 'pos')}, pos) <= 2),
o AS (SELECT id, string_agg(coalesce(new, w), ' ' ORDER BY pos) AS x, count(new) AS c FROM fl LEFT JOIN hit USING (id, pos) GROUP BY 1)"""


@query(f"WITH {INJECT} SELECT id, CASE WHEN coalesce(c, 0) > 0 THEN x ELSE t END AS damaged FROM b LEFT JOIN o USING (id)")
def inject_slang(spark, sf_dir):
    rules = resources.injection_rules(table(spark, sf_dir, "algospeak_dict"))
    return corrupt.inject_slang(metadata(spark, sf_dir), "image_id", "trg_text", rules)


@query()
def inject_spelling(spark, sf_dir):
    return corrupt.inject_spelling(metadata(spark, sf_dir), "image_id", "trg_text", "spelling")


@query()
def inject_typing(spark, sf_dir):
    return corrupt.inject_spelling(metadata(spark, sf_dir), "image_id", "trg_text", "typographic")


def _channel(spark, sf_dir):
    rows = table(spark, sf_dir, "ocr_outputs").select("teks_ocr", "paddleocr_out").distinct()
    return align.channel(rows, "teks_ocr", "paddleocr_out")


@query()
def char_confusion(spark, sf_dir):
    return _channel(spark, sf_dir)[0]


@query()
def channel_insertions(spark, sf_dir):
    """The forty symbols that are most often put in, and the rate of insertions."""
    _, insertions, rate = _channel(spark, sf_dir)
    return align.common_insertions(insertions).join(F.broadcast(rate.select("ins_rate")))  # one row


@query()
def error_prone_chars(spark, sf_dir):
    return align.error_prone(_channel(spark, sf_dir)[0])


@query()
def noisy_text(spark, sf_dir):
    counts, insertions, rate = _channel(spark, sf_dir)
    rows = predictions(spark, sf_dir).select("id", "kalimat_koreksi")
    return corrupt.through_channel(rows, "id", "kalimat_koreksi", checkpointed(counts), checkpointed(insertions), rate.first().ins_rate)


@query(f"SELECT id, rep FROM {PRED}, range(3) t(rep)".replace("SELECT id, rep", "SELECT id, rep::INTEGER AS rep"))
def repeated_rows(spark, sf_dir):
    return corrupt.repeated(predictions(spark, sf_dir).select("id"), 3)


NAMES = {"EJA": "spelling", "SPE": "spelling", "TIP": "typographic", "TYP": "typographic", "ALG": "algospeak"}


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = dataset.mapped(F.upper(F.substring(T.squeeze(F.col("category")), 1, 3)), NAMES, "other")
    return metadata(spark, sf_dir).select(F.col("image_id").alias("id"), name.alias("category"), F.col("src_text").alias("src"), F.col("trg_text").alias("trg"))


def damage_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("spelling", 0.4), ("typographic", 0.3), ("algospeak", 0.2), ("other", 0.1)], "category string, weight double")


@query()
def synthetic_corpus(spark, sf_dir):
    rules = resources.injection_rules(table(spark, sf_dir, "algospeak_dict"))
    return synthetic.generated(clean_texts(spark, sf_dir), damage_weights(spark), 10_000, rules)


@query()
def held_out_set(spark, sf_dir):
    rules = resources.injection_rules(table(spark, sf_dir, "algospeak_dict"))
    return synthetic.held_out(clean_texts(spark, sf_dir), table(spark, sf_dir, "predictions"), "kalimat_koreksi", damage_weights(spark), 2500, rules)


@query(f"""WITH r AS (SELECT image_id, lower({squeezed('split')}) AS split, CASE WHEN category = 'ALG' THEN src_text ELSE '<semantic> ' || src_text END AS t FROM {META} WHERE src_text IS NOT NULL),
g AS (SELECT *, coalesce(nullif(regexp_extract(t, '^<([^>]+)>', 1), ''), 'untagged') AS tag FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY split, tag ORDER BY image_id) AS k FROM g)
SELECT split, tag, count(*) AS n, list(t ORDER BY k) FILTER (k <= 3) AS samples FROM k GROUP BY 1, 2""")
def tag_inventory(spark, sf_dir):
    """Texts of one category stay untagged, the others have a tag; three of each by id."""
    rows = coded(metadata(spark, sf_dir)).where("src_text is not null")
    tagged = rows.select("image_id", F.lower(T.squeeze(F.col("split"))).alias("split"), F.when(F.col("category") == "ALG", F.col("src_text")).otherwise(F.concat(F.lit("<semantic> "), "src_text")).alias("t"))
    return dataset.tag_inventory(tagged, "split", "t", "image_id")


@query(f"SELECT image_id FROM {META} WHERE lower({squeezed('split')}) IN ('val', 'valid', 'validation')")
def validation_rows(spark, sf_dir):
    return metadata(spark, sf_dir).where(dataset.in_split(F.col("split"), "val")).select("image_id")


@query("SELECT crop_id, teks_ocr, coalesce(p.hyp, o.teks_ocr) AS hyp, p.gec_score AS gec_score FROM (SELECT DISTINCT crop_id, teks_ocr FROM ocr_outputs) o LEFT JOIN (SELECT DISTINCT id, hyp, gec_score FROM predictions) p ON crop_id = id")
def hypotheses_or_source(spark, sf_dir):
    """OCR rows with their hypothesis; those without any fall back on their source."""
    hyps = table(spark, sf_dir, "predictions").select(F.col("id").cast("long").alias("id"), "hyp", "gec_score").distinct()
    return dataset.with_hypotheses(ocr(spark, sf_dir), "crop_id", "teks_ocr", hyps)


@query("""SELECT o.crop_id AS crop_id, s.sentence_id AS sentence_id FROM (SELECT DISTINCT crop_id, regexp_extract(crop, '([^/]+?)(\\.[^./]*)?$', 1) AS k FROM ocr_outputs) o
JOIN (SELECT DISTINCT ann_id, regexp_extract(filename, '([^/]+?)(\\.[^./]*)?$', 1) || '_' || s.sentence_id AS k, s.sentence_id AS sentence_id FROM (SELECT ann_id, filename, unnest(sentences) AS s FROM annotations) WHERE s.sentence_id IS NOT NULL) s USING (k)""")
def crops_of_sentences(spark, sf_dir):
    """Crops joined to the sentences they show, by `<file>_<sentence>` keys."""
    a = table(spark, sf_dir, "annotations").select("ann_id", "filename", F.explode("sentences").alias("s")).where("s.sentence_id is not null")
    keys = a.select("ann_id", dataset.stem_key(F.col("filename"), F.col("s.sentence_id")).alias("k"), "s.sentence_id").distinct()
    crops = table(spark, sf_dir, "ocr_outputs").select("crop_id", F.regexp_extract("crop", r"([^/]+?)(\.[^./]*)?$", 1).alias("k")).distinct()
    return crops.join(keys, "k").select("crop_id", "sentence_id")


# Plug-ins and streaming


@query(f"SELECT id::BIGINT AS id, source, source AS hyp FROM {PRED}")
def corrector_default(spark, sf_dir):
    return plugins.correct(predictions(spark, sf_dir), "id", "source").select("id", "source", "hyp")


@query(f"""WITH {RUL}, t AS (SELECT id, unnest({token_list('source')}) AS t, generate_subscripts({token_list('source')}, 1) AS pos FROM {PRED}),
c AS (SELECT id, string_agg(coalesce(target, t), ' ' ORDER BY pos) AS x, count(target)::DOUBLE AS n FROM t LEFT JOIN rul ON t = variant GROUP BY 1)
SELECT id::BIGINT AS id, CASE WHEN source IS NOT NULL THEN coalesce(x, '') END AS hyp, coalesce(n, 0) AS gec_score FROM {PRED} LEFT JOIN c USING (id)""")
def corrected_by_rules(spark, sf_dir):
    """A corrector made once a task from the rule table, fed Arrow batches."""
    rules = {r.variant: r.target for r in resources.lookup(table(spark, sf_dir, "algospeak_dict")).collect()}  # a fixed, small table
    return plugins.correct(predictions(spark, sf_dir), "id", "source", lambda: plugins.RuleCorrector(rules)).select("id", "hyp", "gec_score")


@query(NORM_TEXT)
def streamed_norm(spark, sf_dir):
    """The normaliser over the OCR table as a stream of files."""
    ocr(spark, sf_dir).repartition(2).write.parquet(path := scratch(spark, "incoming"))
    out = scratch(spark, "normalized")
    stream = spark.readStream.schema("crop_id long, teks_ocr string").option("maxFilesPerTrigger", 1).parquet(path)
    words, rules = resources.lexicon(table(spark, sf_dir, "lexicon")), resources.lookup(table(spark, sf_dir, "algospeak_dict"))
    normalize_stream(stream, "crop_id", "teks_ocr", words, rules, out, scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select(F.col("id").alias("crop_id"), "normalized")
