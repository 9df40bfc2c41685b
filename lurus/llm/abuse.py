"""Problem 9: abusive, hateful or sexual content, by compression distance.

A text is read in windows of six words. Each of several members has two zstandard dictionaries of equal make: the same ordinary text, followed in one by
windows of toxic documents, in the other by ordinary windows, those first that the toxic dictionary compresses best. A member's score of a window is how
many bytes fewer it takes with the toxic dictionary than with the ordinary one; a window that even the toxic dictionary leaves above SHARE of its length
scores 0. Windows whose score by the first member reaches GATE have the mean of all members, the others the first member's. A document's score is its
highest window's. Which windows of a toxic document are the toxic ones is not labelled: in a few rounds, dictionaries made from the other documents pick
the windows that score above nearly all ordinary ones; windows that SEVERAL ordinary documents hold, and toxic ones no more often, are never picked. The
threshold is the score of best F1 on labelled documents that the dictionaries never saw, ordinary ones counted ORDINARY times, as labels are given to
suspicious documents more often than to others.

Words are compared after folding: compatibility forms, look-alike letters, digits and marks used as letters, v for u, letters set apart, repeated letters, invisible characters.

The fit uses a bounded sample of labelled rows, MAX_TOXIC and MAX_ORDINARY documents of at most MAX_CHARS characters, chosen by hash; scoring covers all
documents and whole texts.

Defined results: null, empty and wordless texts score null and are not found; labels that are null or contradict each other are not used; with no toxic
or no ordinary label nothing is found; repeated rows are scored each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurus.plans.session import importable, spread

WORDS, STEP, LEVEL = 6, 2, 12
#: Bytes of each half of a dictionary, and number of dictionary pairs.
HALF, MEMBERS = 120_000, 3
#: See above.
GATE, SHARE, ORDINARY = 3, 0.75, 2
MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 3000, 8000, 20_000
#: Ordinary windows that compete for the ordinary dictionary, and the quantiles of their scores above which windows count as toxic, round by round.
RIVALS, QUANTILES = 50_000, (0.98, 0.995, 0.998, 0.998)
#: Ordinary windows that score as high as this quantile of the chosen toxic ones are taken for wrong labels and stay out of the ordinary dictionary.
SURE = 0.5
#: Ordinary documents that show a window to be harmless.
SEVERAL = 3
FOLDS = 4
#: Used where too few labels are left to calibrate.
THRESHOLD, LEAST_LABELS = 8.0, 8

#: Cyrillic and Greek letters that look like Latin ones, and digits, marks and letters that stand for letters.
LOOK_ALIKE = str.maketrans("аеорсухіјѕԁӏαονρτικ", "aeopcyxijsdlaovptik")
AS_LETTER = str.maketrans("0134578962@$!|v", "oieastbggzasilu")
INVISIBLE = re.compile("[­​-‏⁠﻿̀-ͯ]")
SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|[\r\n]+|[^\w\s.,!?;:'\"()*@$\-/&#“”«»…|]+")


@lru_cache(200_000)
def fold_word(word: str) -> str:
    """A word's letters and stars in their plainest form; one without a letter is `#`, bare marks are nothing."""
    core = word.strip(".,!?;:\"'()“”«»…")
    if any(ch.isalpha() for ch in core):
        return re.sub(r"[^\w*]|[\d_]", "", re.sub(r"(.)\1+", r"\1", core.translate(AS_LETTER)))
    return "#" if core else ""


def spelled(words: list[str]) -> list[str]:
    """Three or more single letters in a row as the word that they spell."""
    out: list[str] = []
    for single, run in groupby(words, lambda w: len(w) == 1 and w != "#"):
        run = list(run)
        out += ["".join(run)] if single and len(run) > 2 else run
    return out


def windows(text: str | None) -> list[str]:
    """Windows of WORDS folded words, STEP apart, that do not cross the end of a sentence; each different one once."""
    out: dict[str, None] = {}
    plain = INVISIBLE.sub("", unicodedata.normalize("NFKD", text or "")).lower().translate(LOOK_ALIKE)
    for sentence in SENTENCE_END.split(plain):
        words = spelled([w for w in map(fold_word, sentence.split()) if w])
        for at in range(0, max(1, len(words) - WORDS + STEP), STEP):
            if words[at : at + WORDS]:
                out[" ".join(words[at : at + WORDS])] = None
    return list(out)


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=128, dict_size=len(data), write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)


def head(items: Iterable[str], size: int) -> list[str]:
    """The first items that fit `size` bytes, a byte between them."""
    out, used = [], 0
    for x in items:
        used += len(x.encode()) + 1
        if used > size:
            break
        out.append(x)
    return out


def joined(items: Iterable[str]) -> bytes:
    return "\n".join(items).encode() or b"\n" * 8


class Pair:
    """A toxic and an ordinary dictionary; calling it scores a window."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)

    def __call__(self, window: str) -> int:
        data = window.encode()
        return len(self.ordinary.compress(data)) - len(self.toxic.compress(data))

    def pruned(self, window: str) -> int:
        """The score, or 0 without a second compression where the toxic dictionary does too little."""
        data = window.encode()
        size = len(self.toxic.compress(data))
        return len(self.ordinary.compress(data)) - size if size <= SHARE * len(data) else 0


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[tuple[bytes, bytes], ...]
    threshold: float

    def scorer(self):
        first, *others = (Pair(*d) for d in self.dictionaries)

        def of_window(window: str) -> float:
            s = first.pruned(window)
            return s if s < GATE else (s + sum(p(window) for p in others)) / (1 + len(others))

        def score(text: str | None) -> float | None:
            return max(map(of_window, windows(text)), default=None)

        return score


def train_pair(toxic: list[list[str]], ordinary: list[list[str]], seed: int) -> tuple[bytes, bytes]:
    """Dictionaries from the windows of toxic and of ordinary documents."""
    rng = random.Random(seed)
    in_toxic, in_ordinary = (Counter(w for ws in docs for w in set(ws)) for docs in (toxic, ordinary))
    # harmless whatever they look like: several ordinary documents have them, and toxic ones no more often
    plain = {w for w, n in in_ordinary.items() if n >= SEVERAL and n * len(toxic) >= in_toxic[w] * len(ordinary)}
    toxic = [[w for w in ws if w not in plain] for ws in toxic]
    order = rng.sample(ordinary, len(ordinary))
    few = max(1, len(order) // 4)
    pool = lambda docs: list(dict.fromkeys(w for ws in docs for w in ws))
    common, rivals = head(pool(order[:few]), HALF), pool(order[few:])[:RIVALS]
    chosen, ranked = toxic, rivals
    for quantile in QUANTILES:
        scores: dict[str, int] = {}
        scored: list[list[tuple[int, str]]] = [[] for _ in toxic]
        for fold in range(FOLDS):
            own = [w for k, ws in enumerate(chosen) if k % FOLDS != fold for w in ws]
            own = head(rng.sample(own, len(own)), HALF)
            size = sum(len(w.encode()) + 1 for w in own)
            pair = Pair(joined(common + own), joined(common + head((w for k, w in enumerate(ranked) if k % FOLDS != fold), size)))
            for k in range(fold, len(toxic), FOLDS):
                scored[k] = [(pair(w), w) for w in toxic[k]]
            for w in rivals[fold::FOLDS]:
                scores[w] = pair(w)
        ladder = sorted(scores.values())
        least = max(ladder[int(len(ladder) * quantile)] + 1, 2) if ladder else 2
        chosen = [[w for s, w in ws if s >= least] for ws in scored]
        sure = sorted(s for ws in scored for s, _ in ws if s >= least)
        most = sure[int(len(sure) * SURE)] if sure else 2**31
        ranked = sorted((w for w in rivals if scores[w] < most or w in plain), key=lambda w: -scores[w])
    own = [w for ws in chosen for w in ws]
    own = head(rng.sample(own, len(own)), HALF)
    size = sum(len(w.encode()) + 1 for w in own)
    return joined(common + own), joined(common + head(ranked, size)[::-1])


def best_threshold(scored: list[tuple[float, int]]) -> float:
    """The score of best F1, ordinary documents counted ORDINARY times, or THRESHOLD where labels are too few."""
    positive = sum(y for _, y in scored)
    if positive < LEAST_LABELS:
        return THRESHOLD
    scored = sorted(scored, reverse=True)
    best, at, hits, found = 0.0, THRESHOLD, 0, 0
    for n, (s, y) in enumerate(scored, 1):
        hits += y
        found += 1 if y else ORDINARY
        if (n == len(scored) or scored[n][0] != s) and 2 * hits / (found + positive) > best:
            best, at = 2 * hits / (found + positive), s
    return at


def parted(rows: list[tuple[str, int]]) -> tuple[list[list[str]], list[list[str]], list[tuple[str, int]]]:
    """Windows of toxic and of ordinary training documents, and the documents kept for the threshold: every fourth of each class."""
    classes = [[t for t, y in rows if y == label] for label in (1, 0)]
    toxic, ordinary = ([windows(d) for k, d in enumerate(docs) if k % 4 or len(docs) < 4] for docs in classes)
    return toxic, ordinary, [(d, y) for docs, y in zip(classes, (1, 0)) for d in docs[::4]]


def fit(spark: SparkSession, rows: list[tuple[str, int]], seed: int = 42) -> Model | None:
    """A model from (text, toxic) rows. Members are trained, and kept documents scored, in tasks of their own."""
    if not {0, 1} <= {y for _, y in rows}:
        return None
    importable(spark)
    toxic, ordinary, held = parted(rows)
    shared = spark.sparkContext.broadcast((toxic, ordinary))  # bounded by MAX_TOXIC, MAX_ORDINARY and MAX_CHARS

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [train_pair(*shared.value, seed + k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in pairs], pa.binary()), pa.array([o for _, o in pairs], pa.binary())], names=["k", "toxic", "ordinary"])

    got = spark.range(0, MEMBERS, 1, MEMBERS).mapInArrow(members, "k long, toxic binary, ordinary binary").collect()
    model = Model(tuple((bytes(r.toxic), bytes(r.ordinary)) for r in sorted(got, key=lambda r: r.k)), THRESHOLD)
    docs = spark.createDataFrame([(y, t) for t, y in held], "doc_id long, text string")
    scored = [(r.score, r.doc_id) for r in scores(docs, model).collect() if r.score is not None]
    return Model(model.dictionaries, best_threshold(scored))


def labelled(df: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded training sample."""
    agreed = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("hi")).where("toxic = hi")
    texts = df.select("doc_id", "text").where(F.length("text").between(1, MAX_CHARS)).join(agreed, "doc_id")
    picked = lambda y, n: [(r.text, y) for r in texts.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(n).collect()]
    return picked(1, MAX_TOXIC) + picked(0, MAX_ORDINARY)


def scores(df: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, found) of every document."""
    rows = df.select(F.col("doc_id").cast("long"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("found"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # MEMBERS * 4 * HALF bytes at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, least = shared.value.scorer(), shared.value.threshold
        for batch in batches:
            got = [of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64()), pa.array([s is not None and s >= least for s in got], pa.bool_())], names=["doc_id", "score", "found"])

    return spread(rows).mapInArrow(score, "doc_id long, score double, found boolean")
