from pyspark.sql import functions as F

from lurus.operators import align, corrupt, dataset, gating, plugins, quality, resampling, sampling, scoring


def counts(spark, src, hyp, ref):
    row = spark.createDataFrame([(src, hyp, ref)], "s string, h string, r string").select(scoring.token_counts(F.col("s"), F.col("h"), F.col("r")).alias("c")).first().c
    return row.tp, row.fp, row.fn


def test_token_counts(spark):
    assert counts(spark, "k3p4l4 mayat di jalan", "kepala mayat di jalan", "kepala mayat di jalan") == (1, 0, 0)
    assert counts(spark, "k3p4l4 mayat di jalan", "k3p4l4 sayat di jalan", "kepala mayat di jalan") == (0, 1, 1)
    assert counts(spark, "a x", "a y", "a b") == (0, 0, 1)
    assert counts(spark, None, "a", "") == (0, 1, 0)


def test_edits(spark):
    df = spark.createDataFrame([("saya makan nasi goreng", "saya memakan nasi goreng", "saya memakan nasi goreng"), ("rumah di grobogan", "rumah di grobagi", "rumah di grobogan"), (None, "", None)], "s string, h string, r string")
    assert [(r.tp, r.fp, r.fn) for r in align.edit_counts(df, "s", "h", "r").collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 0)]


def test_total_is_not_a_category(spark):
    df = spark.createDataFrame([("ALL", 1), ("x", 2)], "category string, v int")
    got = {(r.category, r.is_total): r.s for r in scoring.with_total(df, "category", F.sum("v").alias("s")).collect()}
    assert got == {("ALL", 0): 1, ("x", 0): 2, (None, 1): 3}


def test_char_events_rebuild_both_texts():
    for a, b in (("kepala", "kepaIa"), ("abc", ""), ("", "xy"), ("rumah", "rurnah"), ("aXb", "ab")):
        ev = align.char_events(a, b)
        assert "".join(c for c, _ in ev) == a and "".join(o[1:] if c else o for c, o in ev if o != "DEL") == b


def test_bootstrap_interval_holds_the_point(spark):
    df = spark.createDataFrame([(i, 1 if i % 2 else 0, 6) for i in range(40)], "id int, e int, n int")
    r = resampling.ratio_interval(df, "id", "e", "n", 200).first()
    assert r.n == 40 and r.lo <= r.point <= r.hi
    again = resampling.ratio_interval(df.repartition(7), "id", "e", "n", 200).first()
    assert r == again
    assert resampling.ratio_interval(df.limit(1), "id", "e", "n", 10).first().lo is None
    p = resampling.poisson_replicates(df, "id", 300, 1, "e", "n").agg(F.avg("n").alias("n")).first().n
    assert abs(p - 240) < 20


def test_sign_and_mcnemar(spark):
    df = spark.createDataFrame([(0.5, 0.1, 0, 1), (0.5, 0.5, 1, 1), (0.2, 0.4, 1, 0), (0.3, 0.1, 0, 1)], "a double, b double, x int, y int")
    r = resampling.sign_test(df, "a", "b").first()
    assert (r.better, r.worse, r.ties) == (2, 1, 1) and r.p == 1.0
    m = resampling.mcnemar(df, "x", "y").first()
    assert (m.only_a, m.only_b) == (1, 2)
    assert resampling.sign_test(df.limit(0), "a", "b").first().p == 1.0


def test_gates(spark):
    df = spark.createDataFrame([("s", "h", -1.0), ("s", "h", None), ("s", "h", -2.0)], "s string, h string, g double")
    score = gating.score(F.col("g"))
    at = lambda strict: [r.x for r in df.select(gating.gate(F.col("s"), F.col("h"), score, -2.0, strict).alias("x")).collect()]
    assert at(False) == ["h", "s", "h"] and at(True) == ["h", "s", "s"]


def test_sweep_agrees_with_separate_passes(spark):
    rows = [(float(i % 7), i % 5, (i * 3) % 4, 10) for i in range(50)]
    df = spark.createDataFrame(rows, "s double, a int, b int, n int")
    for r in gating.sweep(df, "s", "a", "b", "n", gating.thresholds(df, "s")).collect():
        assert abs(r.cer - sum(b if s >= r.tau else a for s, a, b, _ in rows) / 500) < 1e-12
    best = gating.best(gating.sweep(df, "s", "a", "b", "n", gating.thresholds(df, "s")), F.lit(0.0)).first()
    assert best.q is None and best.cer == 0.0


def test_split_sizes(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 53 else None) for i in range(60)], "id int, g string")
    got = {(r.g, r.part): r["count"] for r in sampling.stratified_split(df, "g", "id").groupBy("g", "part").count().collect()}
    assert got[("a", "val")] == 5 and got[("a", "test")] == 5 and got[("b", "val")] == 1 and got[("b", "train")] == 1 and got[(None, "val")] == 1


def test_spelling_damage(spark):
    texts = ["satu", "rumah besar sekali di tepi jalan raya", None, "a b c d", "(Kendaraan) bermotor!", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for mode in corrupt.MODES:
        got = [r.damaged for r in corrupt.inject_spelling(df, "i", "t", mode, 2).orderBy("id").collect()]
        assert got[0] == "satu" and got[2] is None and got[3] == "a b c d" and got[5] == ""
        assert len(got[1].split()) == 7 and 1 <= sum(a != b for a, b in zip(got[1].split(), texts[1].split())) <= 2
        assert got[4].startswith("(") and got[4].endswith("!")
        assert got == [r.damaged for r in corrupt.inject_spelling(df.repartition(3), "i", "t", mode, 2).orderBy("id").collect()]


def test_channel_limits(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, None), (3, "")], "id int, t string")
    ch = spark.createDataFrame([("a", "=x", 1), ("b", "DEL", 1), (" ", "=y", 1)], "ch string, outcome string, n bigint")
    ins = spark.createDataFrame([("z", 1)], "ch string, n bigint")
    run = lambda **k: {r.id: r.damaged for r in corrupt.through_channel(df, "id", "t", ch, ins, **k).collect()}
    assert run(ins_rate=0.0) == {1: "xx ", 2: None, 3: ""}
    assert run(ins_rate=1.0) == {1: "xzxz ", 2: None, 3: ""}
    assert run(ins_rate=1.0, sub_only=True) == {1: "xx bb", 2: None, 3: ""}
    assert run(ins_rate=1.0, scale=0.0) == {1: "aa bb", 2: None, 3: ""}


def test_dataset(spark):
    df = spark.createDataFrame([(1, "satu dua satu"), (2, "dua tiga"), (3, None), (4, "satu asing")], "id int, t string")
    vocab = dataset.vocabulary(df.where("id < 3"), "t")
    assert [(r.token, r.token_id) for r in vocab.orderBy("token_id").collect()] == [("dua", 4), ("satu", 5), ("tiga", 6)]
    ids = dataset.encode(df, "id", "t", vocab, most=3)
    assert {r.id: r.ids for r in ids.collect()} == {1: [5, 4, 3], 2: [4, 6, 3], 3: [3], 4: [5, 1, 3]}
    assert {r.id: r.text for r in dataset.decode(ids, "id", "ids", vocab).collect()} == {1: "satu dua", 2: "dua tiga", 3: "", 4: "satu"}
    p = dataset.padded(ids.withColumn("b", F.lit(0)), "ids", "b").where("id = 3").first()
    assert p.padded == [3, 0, 0] and p["mask"] == [1, 0, 0]
    tag = spark.createDataFrame([("alg",), ("Syntactic",), (None,), ("?",)], "c string").select(dataset.tag(F.col("c")).alias("t"), dataset.grammar_group(F.lit("Diksi")).alias("g")).collect()
    assert [r.t for r in tag] == ["<semantic>", "<syntactic>", "<morphological>", "<morphological>"] and tag[0].g == "semantic"


def test_word_pieces(spark):
    cut = align.greedy_pieces(frozenset(["ma", "kan", "##kan", "##an", "##an", "x"]))
    assert [r.p for r in spark.createDataFrame([("makanan x q",), (None,)], "t string").select(cut("t").alias("p")).collect()] == ["ma ##kan ##an x [UNK]", None]
    cut = align.greedy_pieces(frozenset(["makan", "##an", "x"]))
    assert spark.createDataFrame([("makanan x",)], "t string").select(cut("t").alias("p")).first().p == "makan ##an x"


def test_checks_and_columns(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "c")], "Src string, TRG string")
    assert quality.columns_missing(df, {"src": (), "target": ("trg",), "split": ()}) == ["split"]
    got = {r.check_name: r.status for r in quality.checks(df, {"x": (F.lit(0.2), 0.1, 0.3), "y": (F.lit(0.0), 0.1, 0.3), "z": (F.lit(None).cast("double"), 0, 0), "w": (F.lit(9), 0, 1)}).collect()}
    assert got == {"x": "warn", "y": "pass", "z": "skip", "w": "fail"}


def test_plugins(spark):
    class Loud:
        def correct(self, texts):
            return [(t.upper(), 0.5) for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert [(r.hyp, r.gec_score) for r in plugins.correct(df, "id", "t", Loud).orderBy("id").collect()] == [("A", 0.5), (None, 0.5)]
    images = spark.createDataFrame([("p", bytearray(b"12"))], "path string, content binary")
    assert plugins.recognise(images).first().ocr_output == ""
    assert bytes(images.select(plugins.transform_images(F.col("content"), lambda b: b[::-1]).alias("c")).first().c) == b"21"


def test_synthetic_pairs(spark):
    from lurus.operators import synthetic

    rows = [(i, ("spelling", "typographic", "algospeak", "other")[i % 4], None if i == 4 else f"sumber {i}", None if i == 8 else f"orang dari rumah nomor {i} di jalan raya besar") for i in range(200)]
    clean = spark.createDataFrame(rows, "id long, category string, src string, trg string")
    rules = spark.createDataFrame([("dari", ["dr"]), ("orang", ["0rang", "org"])], "formal string, variants array<string>")
    weights = spark.createDataFrame([("spelling", 0.25), ("typographic", 0.25), ("algospeak", 0.25), ("other", 0.25)], "category string, weight double")
    got = synthetic.generated(clean, weights, 100, rules).collect()
    assert all(r.src != r.trg and r.split == "train" for r in got) and 80 <= len(got) <= 100
    used = spark.createDataFrame([(f"ORANG dari  rumah nomor {i} di jalan raya besar",) for i in range(100)], "t string")
    test = synthetic.held_out(clean, used, "t", weights, 40, rules).collect()
    assert test and all(r.src != r.trg and r.id >= 100 and r.tag.startswith("<") and len(r.category) == 3 for r in test)
    assert {r.category for r in test} == {"SPE", "TYP", "ALG"}


def test_running_mean_and_places(spark):
    from lurus.functions.stats import place_of
    from lurus.functions.text import exact_match

    df = spark.createDataFrame([(i, float(i % 5) if i % 7 else None) for i in range(60)], "i int, v double")
    seen, want = [], {}
    for r in df.orderBy("i").collect():
        seen += [] if r.v is None else [r.v]
        want[r.i] = sum(seen) / len(seen) if seen else None
    got = {r.i: r.running for r in gating.running_mean(df.repartition(5), "v", "i").collect()}
    assert all((got[i] is None and w is None) or abs(got[i] - w) < 1e-12 for i, w in want.items())
    one = spark.createDataFrame([([1, 2, 3, 4], " Ya ", "yA")], "v array<int>, a string, b string").select(place_of(F.col("v"), 0.5).alias("m"), exact_match(F.col("a"), F.col("b")).alias("e")).first()
    assert one.m == 3 and one.e


def test_image_files(spark, tmp_path):
    from lurus.sources import sinks

    df = spark.createDataFrame([(7, bytearray(b"abc")), (8, None)], "i int, c binary")
    assert [tuple(r) for r in sinks.files(df, "i", "c", str(tmp_path / "out")).orderBy("id").collect()] == [(7, "000000007.png", 3), (8, "000000008.png", None)]
    assert (tmp_path / "out" / "000000007.png").read_bytes() == b"abc"


def test_f_interval(spark):
    df = spark.createDataFrame([(i, i % 2, 0, 1 - i % 2) for i in range(30)], "id int, tp int, fp int, fn int")
    r = resampling.f_interval(df, "id", 100).first()
    assert r.lo <= r.point <= r.hi
    one = resampling.f_interval(df.limit(1), "id", 10).first()
    assert one.lo == one.hi == one.point


def test_replicates_are_the_drawn_rows_sums_without_a_join(spark, tmp_path):
    import hashlib

    import numpy as np
    import pyarrow as pa

    from lurus.operators import draws

    df = spark.range(1105).select((F.col("id") * 7 - 3).alias("id"), (F.col("id") % 13).cast("int").alias("e"), F.when(F.col("id") % 5 > 0, F.col("id") % 11 / 7).alias("x"))
    rows = [(r.e, r.x) for r in df.orderBy("id").collect()]
    h = lambda seed, rep, k: int(hashlib.md5(f"{seed}|{rep}|{k}".encode()).hexdigest()[:8], 16)
    drawn = [[rows[h(5, rep, k) % 1105] for k in range(1105)] for rep in range(12)]
    want = {rep: (sum(e for e, _ in d), round(sum(x or 0 for _, x in d), 6)) for rep, d in enumerate(drawn)}
    reps = resampling.replicates(df, "id", 12, 5, "e", "x")
    assert {r.rep: (r.e, round(r.x, 6)) for r in reps.collect()} == want
    plan = reps._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Broadcast", "Exchange", "Generate"))
    # row numbers of more digits than differ within an array; and windows of rows
    for seed, rep, n in ((42, 999, 101_003), (1234567, 10, 20_001), (42, 0, 1)):
        got = np.concatenate(list(draws.draws(seed, rep, n)))
        assert len(got) == n and all(got[k] == h(seed, rep, k) for k in (*range(0, n, 97), n - 1))
    df.orderBy("id").toPandas().assign(i=range(1105)).to_parquet(tmp_path / "a.parquet")
    whole = draws.ROOM, draws.WINDOW, draws.BATCH
    try:
        draws.ROOM, draws.WINDOW, draws.BATCH = 3000, 400, 90
        got = [q for r in draws.sums_with(f"file://{tmp_path}", 1105, 5, ["e", "x"])(iter([pa.record_batch({"rep": pa.array(range(12), pa.int32())})])) for q in r.to_pylist()]
    finally:
        draws.ROOM, draws.WINDOW, draws.BATCH = whole
    assert {q["rep"]: (q["e"], round(q["x"], 6)) for q in got} == want
    # sums of nulls alone are null, no rows give no replicates
    two = df.limit(2).withColumn("x", F.when(F.col("id") > 0, 1.5))
    sums = {r.rep: (r.e, r.x) for r in resampling.replicates(two, "id", 8, 5, "e", "x").collect()}
    ones = {rep: sum(h(5, rep, k) % 2 for k in range(2)) for rep in range(8)}
    assert sums == {rep: (k, 1.5 * k if k else None) for rep, k in ones.items()} and 0 in ones.values()
    assert resampling.replicates(df.limit(0), "id", 3, 5, "e", "x").count() == 0


def resampled(rows, b, seed):
    import hashlib

    n = len(rows)
    return [[rows[int(hashlib.md5(f"{seed}|{rep}|{k}".encode()).hexdigest()[:8], 16) % n] for k in range(n)] for rep in range(b)]


def joins_draws(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any(x in plan for x in ("Generate", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin"))


def test_f_interval_joins_no_draws(spark):
    rows = [(k, k % 3, k % 2, k % 5 % 2) for k in range(40)]
    out = resampling.f_interval(spark.createDataFrame(rows, "id int, tp int, fp int, fn int"), "id", 60, 7)
    assert not joins_draws(out)
    f = sorted((1.25 * tp / (1.25 * tp + 0.25 * fn + fp) for tp, fp, fn in ([sum(r[k] for r in d) for k in (1, 2, 3)] for d in resampled(rows, 60, 7))))
    got = out.first()
    assert (got.n, round(got.lo, 9), round(got.hi, 9)) == (40, round(f[1], 9), round(f[58], 9))


def test_paired_bootstrap_joins_no_draws(spark):
    rows = [(k, (k * 7 % 11 - 5) / 8) for k in range(40)]
    out = resampling.paired_bootstrap(spark.createDataFrame(rows, "id int, diff double"), "id", "diff", 80, 7)
    assert not joins_draws(out)
    means = sorted(round(sum(x for _, x in d) / 40, 9) for d in resampled(rows, 80, 7))
    above, got = sum(m > 0 for m in means) / 80, out.first()
    assert (got.n, round(got.lo, 9), round(got.hi, 9), round(got.p, 9)) == (40, means[2], means[77], round(2 * min(above, 1 - above), 9))
