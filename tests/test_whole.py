"""Queries against plain Python, on small fixtures and small whole tables."""

from __future__ import annotations

import hashlib
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lurus.operators import resampling
from lurus.plans.evaluation import facts
from lurus.plans.queries import QUERIES

PREDICTIONS = "id int, category string, source string, hyp string, kalimat_koreksi string, gec_score double"


@pytest.fixture
def fixture_dir(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, PREDICTIONS).write.parquet(str(tmp_path / "predictions.parquet"))
        return str(tmp_path)

    return write


def test_texts_are_cut_at_128_tokens_alone(spark, fixture_dir):
    words = [f"kata{k}" for k in range(200)]
    text = " ".join(words)
    at = fixture_dir([(1, "EJA", text, " ".join(words[:40]), text, 0.0), (2, "EJA", text, text, text, 0.0)])
    assert {r.id: len(r.ids) for r in QUERIES["encoded"](spark, at).collect()} == {1: 42, 2: 128}
    assert {r.id: r.text for r in QUERIES["decoded"](spark, at).collect()} == {1: " ".join(words[:40]), 2: " ".join(words[:126])}
    assert {r.id: (len(r.padded), sum(r.mask)) for r in QUERIES["padded_batches"](spark, at).collect()} == {1: (128, 42), 2: (128, 128)}


def resampled(values, b):
    """Sums of b resamples of rows, by the same hashed draws."""
    n = len(values)
    draw = lambda rep, k: int(hashlib.md5(f"42|{rep}|{k}".encode()).hexdigest()[:8], 16) % n
    return [[sum(x) for x in zip(*(values[draw(rep, k)] for k in range(n)))] for rep in range(b)]


def test_replicates_are_as_many_as_the_reference_draws(spark, fixture_dir, monkeypatch):
    words = "satu dua tiga empat lima enam tujuh".split()
    at = fixture_dir([(k, "EJA", " ".join(words), " ".join(words[: 7 - k % 3] + ["x"] * (k % 4)), " ".join(words[: 7 - k % 2]), 0.0) for k in range(7)])
    rows = sorted(facts(spark, at).collect(), key=lambda r: r.id)
    rates = sorted(c / n for c, n in resampled([(r.c_hyp, r.r_len) for r in rows], 1000))
    got = QUERIES["boot_ci"](spark, at).first()
    assert (got.lo, got.hi) == (round(rates[25], 6), round(rates[974], 6))
    means = sorted(round(s / 7, 9) for (s,) in resampled([(round(r.cer_hyp - r.cer_source, 9),) for r in rows], 5000))
    got, above = QUERIES["paired_boot"](spark, at).first(), sum(m > 0 for m in means) / 5000
    assert (got.lo, got.hi, got.p) == pytest.approx((means[125], means[4874], 2 * min(above, 1 - above)), abs=2e-6)
    drawn = []
    for name in ("poisson_replicates", "f_interval"):
        f = getattr(resampling, name)
        monkeypatch.setattr(resampling, name, lambda *a, f=f: drawn.append(a[2]) or f(*a))
    assert QUERIES["boot_ci_poisson"](spark, at).count() == QUERIES["boot_f05"](spark, at).count() == 1
    assert drawn == [1000, 1000]


def test_curve_has_the_reference_s_points(spark, sf_dir):
    rows = QUERIES["coverage_curve"](spark, sf_dir).collect()
    assert {(r.exp, r.frac, r.runs) for r in rows} == {(e, f, 5 if 0 < f < 1 else 1) for e in ("rules", "lexicon") for f in (0, 0.25, 0.5, 0.75, 1)}


# Queries that SQL cannot express, against plain Python over whole small tables.


def distinct_rows(spark, sf_dir, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).distinct().collect()]


def test_edit_scores_against_plain_python(spark, sf_dir):
    from lurus.functions.text import mend_spacing

    rows = spark.read.parquet(f"{sf_dir}/predictions.parquet").select("id", "category", "source", "hyp", "kalimat_koreksi", "gec_score").distinct()
    rows = rows.select(*(mend_spacing(F.lower(F.coalesce(c, F.lit("")))).alias(c) for c in ("source", "hyp", "kalimat_koreksi"))).collect()

    def edits(a, b):
        a, b = a.split(), b.split()
        return {(i, j, " ".join(a[i:j]), " ".join(b[k:m])) for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if kind != "equal"}

    both = [(edits(s, h), edits(s, r)) for s, h, r in rows]
    want = tuple(sum(len(x) for x in part) for part in ([g & w for g, w in both], [g - w for g, w in both], [w - g for g, w in both]))
    got = QUERIES["edit_prf"](spark, sf_dir).first()
    assert (got.tp, got.fp, got.fn) == want


def test_channel_against_plain_python(spark, sf_dir):
    counts, inserted, letters = Counter(), Counter(), 0
    for a, b in distinct_rows(spark, sf_dir, "ocr_outputs", "teks_ocr", "paddleocr_out"):
        if a is None or b is None:
            continue
        letters += max(len(a), 1)
        for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if kind == "equal":
                counts.update((x, "=" + x) for x in a[i:j])
            else:
                n = min(j - i, m - k)
                counts.update((a[i + x], "=" + b[k + x]) for x in range(n))
                counts.update((x, "DEL") for x in a[i + n : j])
                inserted.update(b[k + n : m])
    assert {(r.ch, r.outcome): r.n for r in QUERIES["char_confusion"](spark, sf_dir).collect()} == counts
    got = QUERIES["channel_insertions"](spark, sf_dir).collect()
    assert [(r.ch, r.n) for r in got] == sorted(inserted.items(), key=lambda x: (-x[1], x[0]))[:40]
    assert got[0].ins_rate == pytest.approx(sum(inserted.values()) / letters)


def test_word_pieces_against_plain_python(spark, sf_dir):
    words = {" ".join(w.split()).lower() for (w,) in distinct_rows(spark, sf_dir, "lexicon", "w") if w is not None}
    pieces = words | {c for w in words for c in w}

    def cut(word):
        out = []
        while word:
            piece = next((word[:n] for n in range(len(word), 0, -1) if word[:n] in pieces), None)
            if piece is None:
                return ["[UNK]"]
            out.append(piece if not out else "##" + piece)
            word = word[len(piece) :]
        return out

    texts = {i: t for i, t in distinct_rows(spark, sf_dir, "predictions", "id", "kalimat_koreksi")}
    got = {r.id: r.pieces for r in QUERIES["word_pieces"](spark, sf_dir).collect()}
    assert {i: p for i, p in got.items() if texts[i] is not None} == {i: " ".join(p for w in t.lower().split() for p in cut(w)) for i, t in texts.items() if t is not None}


def test_corpora_keep_to_their_budgets(spark, sf_dir):
    made = QUERIES["synthetic_corpus"](spark, sf_dir).collect()
    assert made and all(r.src != r.trg for r in made) and len(made) <= 10_000
    used = {" ".join(t.lower().split()) for (t,) in distinct_rows(spark, sf_dir, "predictions", "kalimat_koreksi") if t is not None}
    fresh = QUERIES["held_out_set"](spark, sf_dir).collect()
    keys = [" ".join(r.trg.lower().split()) for r in fresh]
    assert fresh and not used & set(keys) and len(keys) == len(set(keys)) and len(fresh) <= 2500


def test_reports_refuse_what_they_would_cut(spark):
    from lurus.sources import sinks

    df = spark.range(12).select(F.col("id"), (F.col("id") / 12).alias("share"))
    assert sinks.report(df, "t").count("\n") == 14 and sinks.latex(df).count("&") == 12
    for f in (lambda: sinks.report(df, "t", most=11), lambda: sinks.latex(df, most=11)):
        with pytest.raises(ValueError):
            f()


def test_broadcasts_are_bounded_in_bytes(spark, monkeypatch):
    from lurus.operators import resources

    df = spark.createDataFrame([("x" * 1000,)] * 100, "t string").repartition(2).selectExpr("t", "monotonically_increasing_id() as i")
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert hinted(resources.small(df))
        monkeypatch.setattr(resources, "BROADCAST_BYTES", 50_000)
        assert not hinted(resources.small(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def four(*parts):
    return [int(digest(*parts)[8 * k : 8 * k + 8], 16) / 2**32 for k in range(4)]


def plainly_damaged(word, mode, *seed):
    from lurus.operators import corrupt

    head = next((k for k, c in enumerate(word) if c.isalpha()), len(word))
    end = max((k + 1 for k, c in enumerate(word) if c.isalpha()), default=head)
    core, (a, b, c, _) = word[head:end], four(*seed)
    low, n = core.lower(), end - head
    if n < 3:
        return word
    op = corrupt.MODES[mode][int(a * len(corrupt.MODES[mode]))]

    def letter(at, choices):
        if not choices:
            return core
        new = choices[int(c * len(choices))]
        return core[:at] + (new.upper() if core[at].upper() == core[at] else new) + core[at + 1 :]

    def replaced(pairs):
        fit = [p for p in pairs if p[0] in low]
        if not fit:
            return core
        x, y = fit[int(c * len(fit))]
        new = low.replace(x, y, 1)
        return new if core[0] == low[0] else new[:1].upper() + new[1:]

    any_, vowels = int(b * n), [k for k in range(n) if low[k] in "aeiou"]
    if op == "adjacent":
        core = letter(any_, corrupt.BESIDE.get(low[any_], ""))
    elif op == "double":
        core = core[: any_ + 1] + core[any_:]
    elif op == "swap":
        k = int(b * (n - 1))
        core = core[:k] + core[k + 1] + core[k] + core[k + 2 :]
    elif op == "omit":
        k = 1 + int(b * (n - 2))
        core = core[:k] + core[k + 1 :]
    elif op == "vowel" and vowels:
        k = vowels[int(b * len(vowels))]
        core = letter(k, "aeiou".replace(low[k], ""))
    elif op in ("shape", "pattern"):
        core = replaced(corrupt.SHAPES if op == "shape" else corrupt.PATTERNS)
    return word[:head] + core + word[end:]


@pytest.mark.parametrize("name, mode", [("inject_spelling", "spelling"), ("inject_typing", "typographic")])
def test_damage_against_plain_python(spark, sf_dir, name, mode):
    want = {}
    for i, text in distinct_rows(spark, sf_dir, "syn_metadata", "image_id", "trg_text"):
        words = (text or "").split()
        most = 1 + int(digest(42, i, "n")[:8], 16) % min(3, max(1, len(words) // 5))
        chosen = [k for _, k in sorted((int(digest(42, i, k, "w")[:8], 16), k) for k, w in enumerate(words) if len(w) >= 4)][:most]
        want[i] = " ".join(plainly_damaged(w, mode, 42, i, k) if k in chosen else w for k, w in enumerate(words)) if len(words) >= 2 and chosen else text
    got = {r.id: r.damaged for r in QUERIES[name](spark, sf_dir).collect()}
    assert [(i, want[i], got[i]) for i in want if want[i] != got[i]] == []


def test_noise_against_plain_python(spark, sf_dir):
    def steps(rows):
        total, so_far, out = sum(n for _, n in rows), 0, []
        for x, n in sorted(rows, key=lambda r: (-r[1], r[0])):
            so_far += n
            out.append((so_far / total, x))
        return out

    channel, inserted = {}, []
    from lurus.plans import corpus

    counts, insertions, rate = corpus._channel(spark, sf_dir)
    for r in counts.collect():
        channel.setdefault(r.ch, []).append((r.outcome, r.n))
    channel, inserted, rate = {c: steps(v) for c, v in channel.items()}, steps([(r.ch, r.n) for r in insertions.collect()]), rate.first().ins_rate
    drawn = lambda s, u: next((x for hi, x in s if hi > u), None)

    def one(ch, i, at):
        if ch == " ":
            return ch
        a, b, c, d = four(13, i, at)
        o = drawn(channel.get(ch, []), a)
        if o == "DEL":
            return ""
        return (o[1:] if o else ch) + ((drawn(inserted, d) or "") if c < rate else "")

    texts = {i: t for i, t in distinct_rows(spark, sf_dir, "predictions", "id", "kalimat_koreksi")}
    got = {r.id: r.damaged for r in QUERIES["noisy_text"](spark, sf_dir).collect()}
    want = {i: "".join(one(ch, i, at) for at, ch in enumerate(t)) for i, t in texts.items() if t is not None}
    assert [(i, want[i], got[i]) for i in want if want[i] != got[i]][:3] == []
