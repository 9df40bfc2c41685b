"""The training-data operators against brute force, and their defined results on odd input."""

import itertools
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lurus.llm import abuse, collapse, families, overlap, packing, pieces, proportions, ranking, terms, tokens
from lurus.llm.queries import QUERIES, SQL
from lurus.llm.text import canonical, category_name, split_name
from tests.compare import differences

META = "image_id bigint, src_text string, trg_text string, category string, split string, parent_image_id bigint, origin string, h string, key string, kept string, id string, part string, x string, cell string, text string"


def meta(spark, rows):
    """rows: (id, src, trg[, split, parent, category]); further columns have the names of the operators' working columns."""
    full = [(*r, *(None,) * (6 - len(r))) for r in rows]
    return spark.createDataFrame([(i, a, b, c, s, p, "o", *("clash",) * 8) for i, a, b, s, p, c in full], META)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


# Canonical forms


def test_canonical_forms(spark):
    pairs = [
        ("Apa Kabar, Dunia!", "apakabardunia"), ("A: x; B: y", "axby"), ("B: y | A: x.", "axby"), ("b: Y\na: X", "axby"), ("A: x; B y", "axby"), ("B y; A: x", "byax"), ("A: x", "ax"), ("; ;A: x;", "ax"),
        (None, ""), ("", ""), (" .-! ", ""), ("É１", "é１"), ("A:; B: y", "aby"), ("B: y; :x", "byx"),
    ]
    got = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pairs)], "i int, t string").select("i", canonical(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [p[1] for p in pairs]
    names = spark.createDataFrame([(" Valid ", "EJA"), ("TRAIN　", " mixed"), ("x", "x"), (None, None)], "s string, c string").select(split_name(F.col("s")).alias("s"), category_name(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in names] == [("val", "spelling"), ("train", "mixed"), (None, None), (None, None)]


# 2


def test_sample_meets_quotas(spark):
    rows = [(i, "a", "b", "train" if i % 3 else " Train", None, "EJA" if i < 800 else "ALG" if i < 980 else "mix" if i < 990 else "?") for i in range(1000)] + [(None, "a", "b", "train", None, "EJA"), (2000, "a", "b", None, None, "EJA")]
    targets = spark.createDataFrame([("train", "spelling", 0.5, 0.4, 5), ("train", "algospeak", 0.4, 0.4, 5), ("train", "mixed", 0.1, 0.4, 20), ("train", "syntactic", 0.0, 0.4, 3), ("val", "spelling", 1.0, 0.5, 1), ("val", None, 1.0, 0.5, 1), ("train", "mixed", 0.1, 0.4, 20)], "split string, category string, target_share double, sample_fraction double, min_rows bigint")
    df = meta(spark, rows)
    report = {(r.split, r.category): r for r in proportions.report(proportions.reservoirs(df, targets), targets).collect()}
    assert report["train", "spelling"].quota == 198 and report["train", "algospeak"].quota == 159 and not report["train", "algospeak"].exhausted
    assert report["train", "mixed"].quota == 10 and report["train", "mixed"].exhausted and report["train", "syntactic"].exhausted and report["val", "spelling"].exhausted and len(report) == 5
    got = proportions.sample(df, targets)
    assert {r.category: r["count"] for r in got.groupBy("category").count().collect()} == {"spelling": 198, "algospeak": 159, "mixed": 10}
    assert {r.id for r in got.collect()} == {r.id for r in proportions.sample(df.repartition(5), targets).collect()}
    assert proportions.sample(df.limit(0), targets).count() == 0 and proportions.report(proportions.reservoirs(df.limit(0), targets), targets).where("exhausted").count() == 5


def test_reservoirs_keep_no_more_than_a_quota_can_be(spark, monkeypatch):
    monkeypatch.setattr(proportions, "SLACK", 10)
    df = meta(spark, [(i, "a", "b", "train", None, "EJA" if i % 10 else "ALG") for i in range(1000)]).repartition(3)
    targets = spark.createDataFrame([("train", "spelling", 0.1, 0.5, 5), ("train", "algospeak", 0.9, 0.5, 5)], "split string, category string, target_share double, sample_fraction double, min_rows bigint")
    state = proportions.reservoirs(df, targets)
    kept = {r.category: r["count"] for r in state.where("id is not null").groupBy("category").count().collect()}
    assert 50 <= kept["spelling"] <= 3 * 51 and kept["algospeak"] == 100
    lowest = lambda category, n: {r.id for r in proportions.named(proportions.known(df)).withColumn("p", ranking.priority(F.col("id"))).where(F.col("category") == category).orderBy("p", "id").limit(n).collect()}
    got = proportions.sample(df, targets)
    assert {r.id for r in got.where("category = 'spelling'").collect()} == lowest("spelling", 50)
    assert {r.id for r in got.where("category = 'algospeak'").collect()} == lowest("algospeak", 100)


def test_ranks_are_exact(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"))
    cuts = spark.createDataFrame([(0, "a", 0, 700), (0, "b", 700, 701), (0, "c", 701, 2500), (1, "a", 10, 20)], "g long, name string, lo long, hi long")
    got = {(r.g, r.name): r["count"] for r in ranking.cut_by_rank(df, ["g"], "k", cuts).groupBy("g", "name").count().collect()}
    assert got == {(0, "a"): 700, (0, "b"): 1, (0, "c"): 1799, (1, "a"): 10}


# 3


def brute_families(rows, form):
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = {}
    for i, _, text, _, parent in rows:
        if i is None:
            continue
        for other in ([seen.setdefault(form(text), i)] if form(text) else []) + ([parent] if parent in root else []):
            a, b = find(i), find(other)
            root[max(a, b)] = min(a, b)
    return {(find(i), i) for i in root if find(i) != i}


def test_families_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "s", rng.choice(["", None, " .", *(f"Kata {rng.randrange(150)}!" for _ in range(3))]), None, rng.choice([None, None, rng.randrange(400), 10_000])) for i in rng.sample(range(400), 300)]
    rows += [(1000 + i, "s", None, None, 1000 + i + 1 if i < 60 else None) for i in range(61)]  # a chain
    rows += [(2000 + i, "s", "panas", None, None) for i in range(150)] + [(None, "s", "panas", None, 3)]
    want = brute_families(rows, lambda t: "".join(ch for ch in (t or "").lower() if ch.isalnum()))
    for df in (meta(spark, rows), meta(spark, rows).repartition(7)):
        assert {tuple(r) for r in families.families(df).collect()} == want


def test_splits_keep_families(spark):
    rows = [(i, "s", f"kalimat {i // 3 if i < 300 else i}" if i < 900 else "sama", None, None) for i in range(1000)]
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split string, target_share double")
    got = families.assign_splits(meta(spark, rows), targets)
    assert got.groupBy("family_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0 and got.count() == 1000
    shares = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert abs(shares["train"] - 800) <= 3 and abs(shares["val"] - 100) <= 3
    assert families.families(meta(spark, rows).limit(0)).count() == 0 and families.assign_splits(meta(spark, rows).limit(0), targets).count() == 0


def test_greedy_in_bulk_is_greedy():
    for seed in range(20):
        rng = random.Random(seed)
        classes = [(s, rng.randrange(1, 3000 // s)) for s in rng.sample(range(1, 40), 6)]
        targets = [("a", 0.7), ("b", 0.2), ("c", 0.1)]
        total = sum(s * n for s, n in classes)
        lack = [share * total for _, share in targets]
        for s, n in sorted(classes, reverse=True):
            for _ in range(n):
                i = max(range(3), key=lambda j: (lack[j], -j))
                lack[i] -= s
        got = families.greedy_quotas(classes, targets)
        assert all(sum(got[s]) == n for s, n in classes)
        filled = [sum(s * q[i] for s, q in got.items()) for i in range(3)]
        assert all(abs(share * total - f - d) <= max(s for s, _ in classes) for (_, share), f, d in zip(targets, filled, lack))


# 4


def test_terms_with_recursive_splits(spark):
    rows = [("f", i, f"Umum kata{i % 40} KATA{i % 7} umum-jarang{i}") for i in range(200)] + [("f", 1, "umum lain"), ("f", 1, "umum lain"), ("f", None, "tak"), ("f", 500, None), ("f", 501, " ."), ("g", 1, "x")]
    texts = spark.createDataFrame(rows, "field_name string, record bigint, text string")
    want = {}
    for f, i, t in set(rows):
        for w in "".join(ch if ch.isalnum() else " " for ch in (t or "")).lower().split() if i is not None else []:
            want.setdefault((f, w), []).append(i)
    for limit in (10**6, 3):
        got = {(r.field_name, r.term): (r.n_records, r.n_occurrences) for r in terms.count_terms(texts, limit).collect()}
        assert got == {k: (len(set(v)), len(v)) for k, v in want.items()}
    marks = {r.term: r["mark"] for r in terms.marked(texts).where("field_name = 'f'").collect()}
    assert marks["umum"] == "common" and marks["jarang5"] == "rare" and marks["kata9"] is None and marks["lain"] == "rare"
    assert terms.count_terms(texts.limit(0)).count() == 0


# 5


def near(a, b):
    if not a or not b:
        return False
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1] <= max(len(a), len(b)) // 7


def test_overlaps_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))

    def worn(t, n):
        t = list(t)
        for _ in range(n):
            t[rng.randrange(len(t))] = rng.choice("abcxyz")
        return "".join(t)

    base = [sentence(14) for _ in range(60)]
    rows = [(i, t.upper(), worn(t, 2), "train") for i, t in enumerate(base)]
    rows += [(100 + i, worn(t, i % 6), None, "val" if i % 2 else "TEST ") for i, t in enumerate(base)]
    rows += [(200 + i, sentence(14), sentence(3), rng.choice(["train", "test"])) for i in range(60)]
    rows += [(300, "ab", "", "train"), (301, "A-b.", None, "val"), (302, "", None, "val"), (303, None, " . ", "train"), (304, base[0], base[0], None)]
    rows += [(400 + i, "teks yang sama di banyak catatan sekali", f"lain {i}", "train" if i % 4 else "val") for i in range(40)]
    rows += [(500, base[1] * 400, None, "train"), (501, base[1] * 400 + "x", None, "val")]
    form = lambda t: "".join(ch for ch in (t or "").lower() if ch.isalnum())
    held = [r for r in rows if (r[3] or "").strip().lower() in ("val", "test")]
    small = lambda r: r[0] < 500
    want = {(t[0], e[0]) for t, e in itertools.product([r for r in rows if r[3] == "train" and small(r)], filter(small, held)) if any(near(form(a), form(b)) for a in t[1:3] for b in e[1:3])} | {(500, 501)}
    got = {tuple(r) for r in overlap.cross_pairs(meta(spark, rows)).collect()}
    assert not got - want and len(got) >= 0.95 * len(want)
    report = {r.id: r.exact for r in overlap.overlapped(meta(spark, rows)).collect()}
    assert set(report) == {e for _, e in got} and report[400] and not report[501]
    assert overlap.cross_pairs(meta(spark, rows).limit(0)).count() == 0


def test_edits_spread_evenly_up_to_a_seventh(spark):
    rng, rows, want = random.Random(5), [], set()
    for k, n in enumerate([*range(7, 150, 3), 300, 1000]):
        t = "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
        for edits in (n // 7, n // 7 + 1):
            e = list(t)
            for j in range(edits):
                e[int((j + 0.5) * n / edits)] = "xyz"[j % 3]
            rows.append((10 * k + edits - n // 7 + 1, "".join(e), None, "val"))
        long = "".join(c + "w" * (j % 7 == 3 and j // 7 < n // 7) for j, c in enumerate(t))  # a letter put in, so that the other is the longer text
        rows += [(10 * k, t, None, "train"), (10 * k + 3, long, None, "test")]
        want |= {(10 * k, 10 * k + 1), (10 * k, 10 * k + 3)}
    got = {tuple(r) for r in overlap.cross_pairs(meta(spark, rows), exhaustive=True).collect()}
    assert got == want
    assert {r.id for r in overlap.overlapped(meta(spark, rows), exhaustive=True).collect()} == {e for _, e in want}
    assert not {tuple(r) for r in overlap.cross_pairs(meta(spark, rows)).collect()} - want


def test_digests_find_what_the_exhaustive_search_finds(spark, sf_dir):
    """All equal texts, and all but a few in a thousand of the near ones."""
    df = spark.read.parquet(f"{sf_dir}/syn_metadata.parquet")
    all_, got = (overlap.cross_pairs(df, exhaustive=x) for x in (True, False))
    assert got.exceptAll(all_).isEmpty() and got.count() >= 0.99 * all_.count()


def test_more_variants_of_a_text_than_a_run_may_have(spark, tmp_path):
    """Every run that a pair shares is common, or no two chunks in a row are left whole: all of them are pairs nevertheless."""
    rng = random.Random(11)

    def worn(t, n):
        t = list(t)
        for k in rng.sample(range(len(t)), n):
            t[k] = rng.choice("xyz")
        return "".join(t)

    base = "".join(rng.choice("abcdefghijklmnop") for _ in range(105))
    rows = [(i, worn(base, 8), None, "train") for i in range(300)] + [(1000 + i, worn(base, i), None, "val") for i in range(0, 8)]
    meta(spark, rows).write.parquet(f"{tmp_path}/syn_metadata.parquet")
    want = {(i, 1000 + k) for i in range(300) for k in range(0, 8)}
    assert all(near(rows[i][1], rows[300 + k][1]) for i in range(0, 300, 10) for k in range(8))
    assert {tuple(r) for r in QUERIES["p5_found"](spark, str(tmp_path)).collect()} == want
    assert {(r.image_id, r.near_texts, r.near_records) for r in QUERIES["p5_links"](spark, str(tmp_path)).collect()} == {(1000 + k, 300, 300) for k in range(8)}


def test_the_exhaustive_search_against_brute_force():
    """Texts of shared phrases, edited at random: pieces in a row that stand unchanged, and ones that stand in many texts."""
    rng = random.Random(2)
    phrases = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 30))) for _ in range(25)]

    def edited(t, n):
        for _ in range(n):
            k = rng.randrange(len(t))
            t = rng.choice([t[:k] + t[k + 1 :], t[:k] + rng.choice("abxy") + t[k:], t[:k] + rng.choice("abxy") + t[k + 1 :]]) or "a"
        return t

    texts = ["".join(rng.choice(phrases) for _ in range(rng.randrange(1, 8))) for _ in range(40)]
    train, held = ([edited(t, rng.randrange(len(t) // 7 + 2)) for t in texts for _ in range(3)] for _ in range(2))
    t, e = pieces.Pieces(held).candidates(pieces.Letters(train))
    found = set(zip(t.tolist(), e.tolist()))
    want = {(i, k) for i, a in enumerate(train) for k, b in enumerate(held) if abs(len(a) - len(b)) <= max(len(a), len(b)) // 7 and near(a, b)}
    assert len(want) > 150 and want <= found


def test_the_exhaustive_search_where_many_texts_meet_at_a_run(monkeypatch):
    """All pairs are found whether runs are compared all with all or one by one, and texts of other lengths are not looked up at all."""
    rng = random.Random(4)
    words = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    start, end = words(14), words(14)
    train = [start + words(50) + end for _ in range(150)]
    held = ["".join("z" if rng.random() < 0.08 else c for c in t) for t in train for _ in range(2)]
    want = {(i, k) for i, a in enumerate(train) for k in (2 * i, 2 * i + 1) if near(a, held[k])}
    assert len(want) > 200
    for dense in (1, 1 << 60):
        monkeypatch.setattr(pieces, "DENSE", dense)
        t, e = pieces.Pieces(held).candidates(pieces.Letters(train))
        assert want <= set(zip(t.tolist(), e.tolist())) and len(t) < 2 * len(want)
    assert pieces._lookups(78, np.array([60, 100])) == [] and len(pieces._lookups(78, np.array([60, 78, 100]))) == 1


def test_links_of_a_sentence_that_most_records_share(spark):
    rows = [(i, "Satu kalimat yang ada di mana-mana di semua catatan", None, "train" if i % 2 else "val") for i in range(3000)] + [(9000, "Satu kalimat yang ada di mana-mana di semua catatn", None, "test")]
    got = {r.id: (r.near_texts, r.near_records) for r in overlap.links(meta(spark, rows)).collect()}
    assert len(got) == 1501 and set(got.values()) == {(1, 1500)}


def test_a_run_that_all_texts_share_brings_few_together():
    rng = random.Random(3)
    words = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    notice = words(60)
    texts = [notice + words(60) for _ in range(4000)]
    texts += [t[:70] + "x" + t[71:] for t in texts[:50]]
    h = np.arange(len(texts)) * 7919
    rows = overlap.run_rows(pa.array(texts), h, np.arange(len(texts)) < 4000, {})
    met = set(zip(*(x.tolist() for x in overlap.meetings(rows)[:2])))
    assert {(7919 * i, 7919 * (4000 + i)) for i in range(50)} <= met and len(met) < 20_000  # of 200,000
    heavy = {0: np.unique(rows["key"][:20])}
    again = set(zip(*(x.tolist() for x in overlap.meetings(overlap.run_rows(pa.array(texts), h, np.arange(len(texts)) < 4000, heavy))[:2])))
    assert {(7919 * i, 7919 * (4000 + i)) for i in range(50)} <= again
    assert (overlap.unpacked(overlap.packed(rows), len(rows)) == rows[np.argsort(rows["key"], kind="stable")]).all()


def test_digests_depend_on_content_alone():
    text = "penjaga mengangkat tiga karung beras ke gudang dekat pelabuhan sebelum hujan turun".replace(" ", "")

    def of(*ts):
        rows = overlap.run_rows(pa.array(ts), np.arange(len(ts)), np.ones(len(ts), bool), {})
        return [set(rows["key"][(rows["text"] == k) & (rows["key"] < 1 << overlap.KEY_BITS)].tolist()) for k in range(len(ts))]

    one = of(text)[0]
    assert of("x", text, "yy", text)[1] == one == of("x", text, "yy", text)[3]
    assert len(one & of("awalan" + text)[0]) > len(one) / 2
    assert len(of("a")[0]) == 1


# 6


def test_copies_across_partition_borders(spark):
    rows = [(i, "Panas: a; Dingin: b", "Teks.", None) for i in range(500)] + [(1000, "teks", "DINGIN: B | PANAS: A"), (1001, "teks", "dingin b panas a"), (1002, None, "teks"), (1003, "", ""), (1004, "x", "y"), (1005, "Y", "x!"), (1006, "x", "x"), (None, "x", "y")]
    want = {(0, i) for i in [*range(1, 500), 1000, 1001]} | {(1004, 1005)}
    for n in (1, 3, 16):
        assert {tuple(r) for r in collapse.copies(meta(spark, rows), "image_id", ("src_text", "trg_text"), n).collect()} == want
    got = {r.id: r.copies for r in collapse.collapsed(meta(spark, rows), "image_id", ("src_text", "trg_text")).collect()}
    assert got == {0: 502, 1004: 2, 1002: 1, 1003: 1, 1006: 1}
    assert collapse.copies(meta(spark, rows).limit(0), "image_id", ("src_text", "trg_text")).count() == 0


# 7


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.ranks(), special_tokens={})


def test_ids_and_round_trip(spark, reference):
    rng = random.Random(3)
    texts = [
        None, "", " ", "\n\n  x", "Don't WE'll they've", "a b　c d  \t e\x85f\x1cg", "naïve café — “kutip” 😀👩‍👩‍👧 漢字かな", "<|endoftext|> 12345 6½²Ⅳ", "a" * 700, "=" * 500 + "ab" * 300, "﻿​ x́",
        "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1500), 0x1F600 + rng.randrange(60)])) for _ in range(400)), "x y\r\n\r\n z   ", "kata " * 20_000, "0\x00 1",
    ]
    texts += ["sama", "sama"]
    df = spark.createDataFrame([(i // 2, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, row string").repartition(3)
    got = tokens.encode(df)
    want = sorted((i // 2, reference.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert sorted((r.id, list(r.ids)) for r in got.collect()) == want
    back = sorted((r.id, r.text) for r in tokens.decode(got).collect())
    assert back == sorted((i // 2, t or "") for i, t in enumerate(texts))
    assert tokens.encode(df.limit(0)).count() == 0


def test_long_words_merge_alike(spark, reference):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeéx") for _ in range(n)) for n in (1, 2, 5, 60, 239, 241, 900, 5000)] + ["a" * 3000, "ab" * 1500, "é" * 1000]
    df = spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string")
    assert {r.id: list(r.ids) for r in tokens.encode(df).collect()} == {i: reference.encode_ordinary(w) for i, w in enumerate(words)}


@pytest.mark.parametrize("share", [0.0, 0.2, 2.0])
def test_frequent_and_rare_words_alike(spark, reference, monkeypatch, share):
    monkeypatch.setattr(tokens, "HOT_SHARE", share)
    df = spark.createDataFrame([(i, f"kata ke-{i} dan dan dan") for i in range(50)], "doc_id bigint, text string")
    assert all(list(r.ids) == reference.encode_ordinary(f"kata ke-{r.id} dan dan dan") for r in tokens.encode(df).collect())


# 8


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_containers(spark, parts):
    rng = random.Random(parts)
    sizes = [rng.choice([0, None, 1, 7, rng.randrange(1, 2049), rng.randrange(1, 300), 2048, 2049, 10_000]) for _ in range(1500)]
    df = spark.createDataFrame([(i // 2, s, "clash") for i, s in enumerate(sizes)], "item bigint, size bigint, bin string").repartition(parts)
    rows = packing.pack_items(df, open_=8).collect()
    fills, whole = {}, 0
    for r in rows:
        assert (r.bin is None) == (r.size == 0)
        if r.bin is not None:
            fills[r.bin] = fills.get(r.bin, 0) + r.size
        whole += r.size
    assert whole == sum(s or 0 for s in sizes) and max(fills.values()) <= 2048
    assert len(rows) == sum(max(1, -(-(s or 0) // 2048)) for s in sizes)
    assert len(fills) <= 1.1 * whole / 2048 + 8
    assert packing.pack_items(df.limit(0)).count() == 0


# 9


def toy():
    rng = random.Random(2)
    nouns = "penjaga sopir murid kasir bidan perawat nelayan pedagang tukang juru".split()
    things = "karung ember kursi lampu sepeda gerobak pensil topi jaket roti".split()
    plain = lambda: f"{rng.choice(nouns)} {rng.choice(['membawa', 'membeli', 'mencuci', 'menjual'])} {rng.choice(things)} dan {rng.choice(things)} ke {rng.choice(['pasar', 'toko', 'kebun'])}."
    rude = lambda: rng.choice([f"Dasar {rng.choice(nouns)} tolol tidak berguna!", f"Otakmu g0blok seperti {rng.choice(things)} busuk!", "Enyah kau manusia br*ngsek dari sini!"])
    return [(" ".join([plain(), plain(), *([rude()] if y else []), plain()]), y) for y in [1] * 80 + [0] * 400]


def test_toxic_documents_are_found(spark):
    rows = toy()
    random.Random(1).shuffle(rows)
    train, test = rows[:300], rows[300:]
    model = abuse.fit(spark, train)
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(test)] + [(900, None, ""), (901, "", ""), (902, " .!", ""), (903, test[0][0] * 300, "")], "doc_id bigint, text string, score string")
    got = {r.doc_id: (r.score, r.found) for r in abuse.scores(df, model).collect()}
    hits = sum(got[i][1] == bool(y) for i, (_, y) in enumerate(test))
    assert hits / len(test) > 0.95
    assert got[900] == got[901] == got[902] == (None, False) and len(got) == len(test) + 4
    assert abuse.scores(df.limit(0), model).count() == 0
    assert abuse.fit(spark, [("x", 1)]) is None and abuse.scores(df, None).where("found").count() == 0


def test_windows_fold_disguises():
    assert abuse.windows("G0BL0K!!! b4ngeeet, іdіоt") == ["goblok", "banget idiot"]
    assert abuse.windows(None) == [] and abuse.windows("12 34") == ["# #"]
    assert len(abuse.windows("kata " * 100)) < 10


def test_labels_that_contradict_are_not_used(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "x" * 30_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, None), (3, 0), (4, 1), (5, 1), (9, 1)], "doc_id bigint, toxic int")
    assert sorted(abuse.labelled(docs, labels)) == [("b", 1), ("c", 0)]


def test_json_literal_is_folded(spark):
    """The rank table is parsed once by the optimiser, not once a row."""
    plan = spark.range(1).select(F.size(tokens.rank_map()).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and json.loads("1") == 1
