"""Sources. Schemas are explicit; nothing is inferred, bad lines never stop a scan unless asked to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurus.plans.indexing import row_index

ERROR = "struct<token_salah:string,token_benar:string,category:string>"
ANNOTATION = f"filename string, primary_category string, sentences array<struct<sentence_id:string,category:string,teks_ocr:string,kalimat_koreksi:string,bbox_normalized:array<double>,errors:array<{ERROR}>>>"
PREDICTION = "id int, category string, source string, hyp string, kalimat_koreksi string, gec_score double"
#: The sections of the rule dictionary.
SECTIONS = ("abbreviations", "phonetic_substitutions", "number_substitutions", "slang")


def delimited(spark: SparkSession, path: str, schema: str | T.StructType, drop_bad: bool = False) -> DataFrame:
    """A CSV or, by its ending, TSV or TXT scan with a header; quoted fields may hold line breaks. Columns are matched by name."""
    sep = "\t" if path.rstrip("/").lower().endswith((".tsv", ".txt")) else ","
    return spark.read.schema(schema).options(header=True, sep=sep, quote='"', escape='"', multiLine=True, enforceSchema=False, mode="DROPMALFORMED" if drop_bad else "PERMISSIVE").csv(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones give a row of nulls."""
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Rows of a JSON array, or of the first list that an object of the file holds. One file is one row here; large inputs belong in JSON lines."""
    text = spark.read.text(path, wholetext=True)
    rows = F.coalesce(F.from_json("value", f"array<struct<{item}>>", {"mode": "PERMISSIVE"}), F.array())
    listed = F.filter(F.map_values(F.from_json("value", "map<string,string>")), lambda v: F.ltrim(v).startswith("["))
    inner = F.from_json(F.get(listed, F.lit(0)), f"array<struct<{item}>>")
    return text.select(F.explode(F.when(F.ltrim("value").startswith("["), rows).otherwise(inner)).alias("r")).select("r.*")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATION).option("multiLine", True).json(path)


def flattened(records: DataFrame) -> DataFrame:
    """A row for each error, and one for each sentence without any."""
    s = records.select("filename", "primary_category", F.posexplode_outer("sentences").alias("sentence_pos", "s"))
    e = s.select("filename", "primary_category", "sentence_pos", "s.sentence_id", "s.category", "s.teks_ocr", "s.kalimat_koreksi", F.posexplode_outer("s.errors").alias("error_pos", "e"))
    return e.select("*", "e.token_salah", "e.token_benar", F.col("e.category").alias("error_category")).drop("e")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file, or of a folder's files by name. A line's place is its file, block and place in the block; ranges of these are numbered."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return row_index(rows, "file", "block", "at", name="line_no").select("line_no", "value")


def aligned(spark: SparkSession, src: str, tgt: str) -> DataFrame:
    """(line_no, src, tgt) of two files, row for row; files of different length are refused."""
    a, b = numbered_lines(spark, src), numbered_lines(spark, tgt)
    if (n := a.count()) != (m := b.count()):
        raise ValueError(f"{n} and {m} lines")
    return a.withColumnRenamed("value", "src").join(b.withColumnRenamed("value", "tgt"), "line_no")


def word_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(w, f) of `word freq` lines: the first and the last field."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(p, F.lit(0)).alias("w"), F.element_at(p, -1).try_cast("int").alias("f"))


def first_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(token): the first token of each line, each once."""
    return spark.read.text(path).select(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).alias("token")).where("token <> ''").distinct()


def generated(spark: SparkSession, path: str) -> DataFrame:
    """(id, score, text) of `H-<id>\\t<score>\\t<text>` lines of a generator's output."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value").startswith("H-") & (F.size(p) >= 3))
    return rows.select(F.substr(F.get(p, F.lit(0)), F.lit(3)).try_cast("int").alias("id"), F.get(p, F.lit(1)).try_cast("double").alias("score"), F.get(p, F.lit(2)).alias("text"))


def rules(spark: SparkSession, text: str) -> DataFrame:
    """(section, formal, variant) of a rule dictionary's JSON text. The file is small by nature and read on the driver; of a key that occurs twice the last holds."""
    data = json.loads(text)
    rows = [(s, formal, v) for s in SECTIONS for formal, vs in data.get(s, {}).items() for v in (vs if isinstance(vs, list) else [vs])]
    rows += [("combined_rules", r["from"], v) for r in data.get("combined_rules", []) if "from" in r and "to" in r for v in (r["to"] if isinstance(r["to"], list) else [r["to"]])]
    return spark.createDataFrame(rows, "section string, formal string, variant string")


def images(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, length, content) of image files; content is read only where it is used."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", "length", "content")


def resolved(df: DataFrame, wanted: dict[str, tuple[str, ...]], default: str | None = None) -> DataFrame:
    """Columns by any of several names, regardless of case; absent ones have the default."""
    have = {c.lower(): c for c in df.columns}
    pick = lambda names: [F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have]
    return df.select(*(F.coalesce(*pick((n, *others)), F.lit(default)).alias(n) for n, others in wanted.items()))
