import json

import pytest

from lurus.sources import readers, sinks


def test_delimited_quoting(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd'), (2, " x "), (3, None)], "id int, t string")
    for ending, sep in ((".csv", ","), (".tsv", "\t")):
        sinks.delimited(df, path := str(tmp_path / ("t" + ending)), sep)
        got = {r.id: r.t for r in readers.delimited(spark, path, "id int, t string").collect()}
        assert got[1] == 'a "b", c\nd' and got[2] == " x " and not got[3]


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2}\n')
    assert sorted((r.id, r.t) for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id int, t string").collect()) == [(1, "x"), (2, None)]
    for text in ('[{"id": 1}, {"id": 2}]', '{"n": 2, "rows": [{"id": 1}, {"id": 2}], "more": [3]}'):
        (tmp_path / "d.json").write_text(text)
        assert [r.id for r in readers.json_document(spark, str(tmp_path / "d.json"), "id:int").collect()] == [1, 2]


def test_aligned(spark, tmp_path):
    (tmp_path / "a").write_text("1\n2\n3\n"), (tmp_path / "b").write_text("x\ny\nz\n"), (tmp_path / "c").write_text("x\n")
    rows = readers.aligned(spark, str(tmp_path / "a"), str(tmp_path / "b")).orderBy("line_no").collect()
    assert [(r.src, r.tgt) for r in rows] == [("1", "x"), ("2", "y"), ("3", "z")]
    with pytest.raises(ValueError):
        readers.aligned(spark, str(tmp_path / "a"), str(tmp_path / "c"))


def test_small_formats(spark, tmp_path):
    (tmp_path / "w").write_text("kata 3\n\n dua  kata 7\nx y\n")
    assert [(r.w, r.f) for r in readers.word_frequencies(spark, str(tmp_path / "w")).collect()] == [("kata", 3), ("dua", 7), ("x", None)]
    (tmp_path / "h").write_text("S-0\tq\nH-0\t-0.5\thalo dunia\nH-1\t-1\nH-2\t-2.5\ta\tb\n")
    assert [(r.id, r.score, r.text) for r in readers.generated(spark, str(tmp_path / "h")).collect()] == [(0, -0.5, "halo dunia"), (2, -2.5, "a")]
    text = json.dumps({"abbreviations": {"yang": ["yg", "y9"]}, "combined_rules": [{"from": "dari", "to": "dr"}, {"from": "dua", "to": ["d2"]}]})
    assert readers.rules(spark, text).count() == 4


def test_images_and_columns(spark, tmp_path):
    (tmp_path / "1.png").write_bytes(b"abc")
    assert [(r.name, r.length) for r in readers.images(spark, str(tmp_path)).select("name", "length").collect()] == [("1.png", 3)]
    df = spark.createDataFrame([("a", None)], "Source string, ref string")
    assert tuple(readers.resolved(df, {"src": ("source",), "ref": (), "hyp": ()}, "-").first()) == ("a", "-", "-")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 0.25), ("c", 0.75)], "name string, share double")
    sinks.run(df, str(tmp_path / "runs"), "r1"), sinks.run(df, str(tmp_path / "runs"), "r2"), sinks.run(df, str(tmp_path / "runs"), "r1")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 4
    assert "█" in sinks.report(df, "Shares") and r"a\_b & 0.25 \\" in sinks.latex(df)
    sinks.document(df.limit(1), str(tmp_path / "doc"))
    assert json.loads(spark.read.text(str(tmp_path / "doc")).first().value) == {"name": "a_b", "share": 0.25}


def test_operators_reach_the_workers_from_any_frame(tmp_path):
    """A frame that the caller read by itself, in a process that did not start in the repository."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from lurus.operators import variants
raw = spark.createDataFrame([(1, '{{"filename": "f"}}')], "ann_id bigint, payload string")
assert variants.raw_nodes(raw).count() == 1
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-2000:]
