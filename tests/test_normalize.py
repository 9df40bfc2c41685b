import pytest
from pyspark.sql import functions as F

from lurus.operators import coverage, resources, scoring
from lurus.operators.normalize import Parts, normalize

WORDS = "sadar hilang ponsel pembunuh ditemukan asusila selingkuh dari celana mabuk video vicky".split()


@pytest.fixture(scope="module")
def base(spark):
    words = spark.createDataFrame([(w, 100) for w in WORDS], "w string, f bigint")
    return words, spark.createDataFrame([("dr", "dari"), ("yg", "yang")], "variant string, target string")


def run(spark, base, texts, parts=Parts()):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("normalized", F.lit("clash"))
    got = {r.id: r.normalized for r in normalize(df, "id", "t", *base, parts).collect()}
    return [got[i] for i in range(len(texts))]


def test_golden_tokens(spark, base):
    cases = {
        "sad4r": "sadar", "hil4ng": "hilang", "P0nsel": "ponsel", "p3mbvnvh": "pembunuh", "ditemvkan": "ditemukan", "as*sila": "asusila", "dr": "dari", "video": "video", "vicky": "vicky",
        "100": "100", "3.1": "3.1", "***": "***", "$adar": "$adar", "(dr!)": "(dari!)", "a*u*i*a": "a*u*i*a", "tidak4": "tidak4", "YG": "yang",
    }
    assert run(spark, base, list(cases)) == list(cases.values())


def test_texts_and_edges(spark, base):
    assert run(spark, base, ["  dr   rumah, sad4r! ", None, "", " \t", "tetap  begini"]) == ["dari rumah, sadar!", None, "", "", "tetap begini"]
    assert run(spark, base, []) == []


def test_ties_follow_option_order(spark):
    words = spark.createDataFrame([("kali", 5), ("kail", 5), ("bau", 5), ("bav", 5)], "w string, f bigint")
    rules = spark.createDataFrame([], "variant string, target string")
    assert run(spark, (words, rules), ["ka11", "b4v", "b*v"]) == ["kail", "bav", "bav"]


def test_components(spark, base):
    assert run(spark, base, ["dr", "sad4r", "as*sila"], Parts(True, False, False)) == ["dari", "sad4r", "as*sila"]
    assert run(spark, base, ["dr", "sad4r", "as*sila", "p3mbvnvh"], Parts(False, False, True)) == ["dr", "sad4r", "asusila", "p3mbvnvh"]
    assert run(spark, base, ["dr", "sad4r", "as*sila"], Parts(False, True, False)) == ["dr", "sadar", "as*sila"]


def test_scope_counts_and_ablation(spark, base):
    e = lambda s, b, c="ALG": (s, b, c)
    rows = [(1, "orang sad4r itu dr rumah", [e("sad4r", "sadar"), e("dr", "dari")]), (2, "as*sila p3mbvnvh hil4ng kata", [e("as*sila", "asusila"), e("p3mbvnvh", "pembunuh"), e("hil4ng", "x"), e("hil4ng", "hilang"), e("kata", "kota", "EJA")])]
    df = spark.createDataFrame(rows, "id int, text string, errors array<struct<token_salah:string,token_benar:string,category:string>>")
    got = {r.config: (r.tp, r.fp, r.fn) for r in coverage.ablation(scoring.scope_tokens(df, "ALG"), *base).collect()}
    assert got["full"] == (5, 0, 0) and got["lookup"] == (1, 0, 4) and got["censor"] == (1, 0, 4) and got["blind"] == (2, 0, 3)


def test_resources(spark):
    rules = spark.createDataFrame([("banget", "bgt"), ("begitu", "bgt"), (" Dari ", "DR"), ("dua", "2"), ("x y", "xy"), ("tidak", "ga k"), (None, "q"), ("z", None)], "formal string, variant string")
    assert sorted(tuple(r) for r in resources.lookup(rules).collect()) == [("dr", "dari"), ("xy", "x y")]
    words = spark.createDataFrame([("Kata", 3), (" kata", 7), ("a", 9), ("ab1", 9), ("satu", 1), (None, 5), ("dua", None)], "w string, f int")
    base = resources.lexicon(words)
    assert [tuple(r) for r in base.collect()] == [("kata", 7)]
    more = resources.augmented(base, spark.createDataFrame([("kata baru, baru! 12",)], "t string"), "t")
    assert sorted(tuple(r) for r in more.collect()) == [("baru", 2), ("kata", 7)]


def test_sampling_of_resources(spark):
    words = spark.createDataFrame([(f"w{i}", i) for i in range(11)], "w string, f bigint")
    parts = coverage.parts_of(words, "w", [0.5, 0.25], 2)
    assert {r.part: r["count"] for r in parts.groupBy("part").count().collect()} == {"0|0.5": 6, "1|0.5": 6, "0|0.25": 3, "1|0.25": 3}
