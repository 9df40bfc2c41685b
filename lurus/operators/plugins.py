"""Interfaces to engines that are not part of this package: text recognition, neural correction, image work. Defaults change nothing.

A factory is called once in each task, so that an engine loads its model there; it is then fed Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurus.plans.session import importable


class Recogniser(Protocol):
    def predict(self, image: bytes) -> str: ...


class Corrector(Protocol):
    def correct(self, texts: list[str]) -> list[tuple[str, float | None]]: ...


class NoRecogniser:
    def predict(self, image: bytes) -> str:
        return ""


class NoCorrector:
    def correct(self, texts: list[str]) -> list[tuple[str, float | None]]:
        return [(t, None) for t in texts]


class RuleCorrector:
    """A corrector without a model: tokens that a small table of rules knows are replaced; the score is how many were."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.rules = rules

    def correct(self, texts: list[str]) -> list[tuple[str, float | None]]:
        out = []
        for text in texts:
            words = text.split()
            out.append((" ".join(self.rules.get(w, w) for w in words), float(sum(w in self.rules for w in words))))
        return out


def recognise(images: DataFrame, factory: Callable[[], Recogniser] = NoRecogniser) -> DataFrame:
    """(path, ocr_output) of (path, content), as read by binaryFile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = factory()
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "ocr_output": [engine.predict(x) if x is not None else None for x in b["content"]]})

    importable(images.sparkSession)
    return images.select("path", "content").mapInPandas(run, "path string, ocr_output string")


def correct(df: DataFrame, id_col: str, text: str, factory: Callable[[], Corrector] = NoCorrector) -> DataFrame:
    """(id, source, hyp, gec_score): hypotheses by a corrector; where it gives none the source stands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = factory()
        for b in batches:
            got = engine.correct(["" if t is None else t for t in b["source"]])
            yield b.assign(hyp=[s if s is None or h is None else h for (h, _), s in zip(got, b["source"])], gec_score=[None if s is None else float(s) for _, s in got])

    importable(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("source"))
    return rows.mapInPandas(run, "id long, source string, hyp string, gec_score double")


def transform_images(content: Column, function: Callable[[bytes], bytes] = lambda x: x) -> Column:
    """Images through a function on their bytes: rendering and augmentation plug in here."""

    @F.pandas_udf("binary")
    def udf(images: pd.Series) -> pd.Series:
        return images.map(lambda x: None if x is None else function(x))

    return udf(content)
