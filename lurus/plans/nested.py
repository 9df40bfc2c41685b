"""Queries: flat tables of nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurus.operators import variants
from lurus.plans.registry import Registry
from lurus.plans.session import scratch, table

query = Registry()


def _opened(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN ({x} ->> '$')::JSON END ELSE {x} END"


def _listed(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'OBJECT' THEN [{x}] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [] END"


_WORDED = "regexp_matches({0}, '[^\\t-\\r\\x{{1C}}-\\x{{1F}} \\x{{85}}\\p{{Z}}]')"
#: The shapes that the test tables hold, spelled out one by one; the operator derives them from its automaton.
P1 = f"""WITH j AS (SELECT ann_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM annotation_raw),
r AS (SELECT ann_id, CASE json_type(j) WHEN 'ARRAY' THEN j -> 0 WHEN 'OBJECT' THEN CASE WHEN json_exists(j, '$.data') THEN j -> 'data' -> 0 WHEN json_exists(j, '$.record') THEN j -> 'record' ELSE j END END AS r FROM j),
a AS (SELECT ann_id, {_opened("(r -> 'sentences')")} AS s FROM r), b AS (SELECT ann_id, {_listed('s')} AS s FROM a),
c AS (SELECT ann_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS sentence_pos FROM b), d AS (SELECT ann_id, sentence_pos, {_opened("(s -> 'errors')")} AS e FROM c),
e AS (SELECT ann_id, sentence_pos, {_listed('e')} AS e FROM d), f AS (SELECT ann_id, sentence_pos, unnest(e) AS e, generate_subscripts(e, 1) - 1 AS error_pos FROM e),
t AS (SELECT ann_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) - 1 AS sentence_pos FROM annotations), u AS (SELECT ann_id, sentence_pos, unnest(s.errors) AS e, generate_subscripts(s.errors, 1) - 1 AS error_pos FROM t),
all_errors AS (SELECT ann_id, sentence_pos, error_pos, e ->> 'token_salah' AS x, e ->> 'token_benar' AS y FROM f UNION ALL SELECT ann_id, sentence_pos, error_pos, e.token_salah, e.token_benar FROM u)
SELECT DISTINCT ann_id, sentence_pos, error_pos FROM all_errors WHERE {_WORDED.format('x')} OR {_WORDED.format('y')}"""


@query(P1)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.found_errors(table(spark, sf_dir, "annotations"), table(spark, sf_dir, "annotation_raw"))


def _form(x: str) -> str:
    inner = f"json_type(({x} ->> '$')::JSON)"
    encoded = f"CASE WHEN json_valid({x} ->> '$') AND {inner} = 'ARRAY' THEN 'encoded-list' WHEN json_valid({x} ->> '$') AND {inner} = 'OBJECT' THEN 'encoded-single' ELSE 'scalar' END"
    return f"CASE coalesce(json_type({x}), 'absent') WHEN 'absent' THEN 'absent' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'single' WHEN 'VARCHAR' THEN {encoded} ELSE 'scalar' END"


#: Every node of either table, once for each time it is stored.
NODES_SQL = f"""WITH j AS (SELECT ann_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM annotation_raw),
w AS (SELECT ann_id, CASE json_type(j) WHEN 'ARRAY' THEN j -> 0 WHEN 'OBJECT' THEN CASE WHEN json_exists(j, '$.data') THEN j -> 'data' -> 0 WHEN json_exists(j, '$.record') THEN j -> 'record' ELSE j END END AS r,
CASE WHEN json_type(j) = 'ARRAY' THEN 'list' WHEN json_exists(j, '$.data') THEN 'envelope+list' WHEN json_exists(j, '$.record') THEN 'envelope' ELSE 'bare' END AS way FROM j),
r AS (SELECT * FROM w WHERE json_exists(r, '$.sentences') OR json_exists(r, '$.filename') OR json_exists(r, '$.primary_category')),
a AS (SELECT ann_id, {_opened("(r -> 'sentences')")} AS s FROM r), b AS (SELECT ann_id, {_listed('s')} AS s FROM a),
c AS (SELECT ann_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS sentence_pos FROM b), cs AS (SELECT * FROM c WHERE json_type(s) = 'OBJECT'),
d AS (SELECT ann_id, sentence_pos, {_opened("(s -> 'errors')")} AS e FROM cs), d2 AS (SELECT ann_id, sentence_pos, {_listed('e')} AS e FROM d),
e AS (SELECT ann_id, sentence_pos, unnest(e) AS e, generate_subscripts(e, 1) - 1 AS error_pos FROM d2), es AS (SELECT * FROM e WHERE json_type(e) = 'OBJECT'),
t AS (SELECT ann_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) - 1 AS sentence_pos FROM annotations), ts AS (SELECT * FROM t WHERE s IS NOT NULL),
u AS (SELECT ann_id, sentence_pos, unnest(s.errors) AS e, generate_subscripts(s.errors, 1) - 1 AS error_pos FROM ts),
records AS (SELECT ann_id, 0::BIGINT AS record_pos, way || ':' || {_form("(r -> 'sentences')")} AS shape, r ->> 'filename' AS filename, r ->> 'primary_category' AS primary_category,
CASE WHEN json_exists(r, '$.anotator') THEN r ->> 'anotator' ELSE r ->> 'annotator' END AS annotator FROM r
UNION ALL SELECT ann_id, 0, 'typed:' || CASE WHEN sentences IS NULL THEN 'null' ELSE 'list' END, filename, primary_category, annotator FROM annotations),
sentences AS (SELECT ann_id, 0::BIGINT AS record_pos, {_form("(s -> 'errors')")} || CASE WHEN json_type(s -> 'bbox_normalized') = 'ARRAY' THEN '+box' ELSE '' END || CASE WHEN coalesce(json_type(s -> 'catatan'), 'NULL') <> 'NULL' THEN '+note' ELSE '' END AS shape,
sentence_pos, s ->> 'sentence_id' AS sentence_id, s ->> 'category' AS category, s ->> 'teks_ocr' AS teks_ocr, s ->> 'kalimat_koreksi' AS kalimat_koreksi,
CASE WHEN json_type(s -> 'bbox_normalized') = 'ARRAY' THEN (s -> 'bbox_normalized')::DOUBLE[] END AS bbox_normalized, CASE WHEN json_type(s -> 'catatan') = 'OBJECT' THEN json(s -> 'catatan')::VARCHAR ELSE s ->> 'catatan' END AS note FROM cs
UNION ALL SELECT ann_id, 0, CASE WHEN s.errors IS NULL THEN 'null' ELSE 'list' END || CASE WHEN s.bbox_normalized IS NOT NULL THEN '+box' ELSE '' END, sentence_pos, s.sentence_id, s.category, s.teks_ocr, s.kalimat_koreksi, s.bbox_normalized, NULL FROM ts),
errors AS (SELECT ann_id, 0::BIGINT AS record_pos, coalesce(nullif(concat_ws('+', CASE WHEN json_exists(e, '$.token_salah') THEN 'token_salah' END, CASE WHEN json_exists(e, '$.token_benar') THEN 'token_benar' END, CASE WHEN json_exists(e, '$.category') THEN 'category' END), ''), 'empty') AS shape,
sentence_pos, error_pos, e ->> 'token_salah' AS token_salah, e ->> 'token_benar' AS token_benar, e ->> 'category' AS category FROM es
UNION ALL SELECT ann_id, 0, 'typed', sentence_pos, error_pos, e.token_salah, e.token_benar, e.category FROM u WHERE e IS NOT NULL)"""


def all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.typed_nodes(table(spark, sf_dir, "annotations")).unionByName(variants.raw_nodes(table(spark, sf_dir, "annotation_raw")), allowMissingColumns=True)


@query(f"{NODES_SQL} SELECT DISTINCT * FROM records")
def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.level(all_nodes(spark, sf_dir), "record")


@query(f"{NODES_SQL} SELECT DISTINCT * FROM sentences")
def p1_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.level(all_nodes(spark, sf_dir), "sentence")


@query(f"{NODES_SQL} SELECT DISTINCT * FROM errors")
def p1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.level(all_nodes(spark, sf_dir), "error")


@query(f"{NODES_SQL} SELECT level, shape, count(*) AS nodes FROM (SELECT 'record' AS level, shape FROM records UNION ALL SELECT 'sentence', shape FROM sentences UNION ALL SELECT 'error', shape FROM errors) GROUP BY 1, 2")
def p1_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes each structural variant of each level has."""
    return all_nodes(spark, sf_dir).groupBy("level", "shape").agg(F.count("*").alias("nodes"))


_COLUMNS = """CASE level WHEN 'record' THEN 'filename,primary_category,annotator'
WHEN 'sentence' THEN 'sentence_pos,sentence_id,category,teks_ocr,kalimat_koreksi' || CASE WHEN contains(shape, '+box') THEN ',bbox_normalized' ELSE '' END || CASE WHEN contains(shape, '+note') THEN ',note' ELSE '' END
ELSE 'sentence_pos,error_pos' || CASE WHEN shape = 'typed' THEN ',token_salah,token_benar,category' ELSE CASE WHEN contains(shape, 'token_salah') THEN ',token_salah' ELSE '' END || CASE WHEN contains(shape, 'token_benar') THEN ',token_benar' ELSE '' END || CASE WHEN contains(shape, 'category') THEN ',category' ELSE '' END END END"""


@query(f"{NODES_SQL} SELECT level, shape, {_COLUMNS} AS columns, count(*) AS table_rows FROM (SELECT 'record' AS level, shape FROM (SELECT DISTINCT * FROM records) UNION ALL SELECT 'sentence', shape FROM (SELECT DISTINCT * FROM sentences) UNION ALL SELECT 'error', shape FROM (SELECT DISTINCT * FROM errors)) GROUP BY 1, 2")
def p1_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of each structural variant, written and read again: its columns besides the keys, and its rows."""
    variants.write_subtypes(all_nodes(spark, sf_dir), path := scratch(spark, "subtypes"))
    rows = spark.read.parquet(path).groupBy("level", "shape").agg(F.count("*").alias("table_rows"))
    columns = F.udf(lambda level, shape: ",".join(variants.columns_of(level, shape)))  # one call for each variant
    return rows.select("level", "shape", columns("level", "shape").alias("columns"), "table_rows")
