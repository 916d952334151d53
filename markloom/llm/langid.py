"""Language identification by hyperdimensional profiles (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
NGRAM = 3
#: Language prototypes go to every task; a table with more lang values than this is refused.
MOST_LANGUAGES = 10_000
#: n-gram vectors that a task remembers before it starts afresh.
REMEMBERED = 200_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """Codes of the letter n-grams of a text in lower case; what is no letter is one gap between words."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    points = np.where(_letters()[points], points, 32)
    points = np.concatenate([[32], points, [32]])
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:] if len(points) >= NGRAM else np.empty(0, np.int64)


class Vectors:
    """Vectors of n-grams: random +1/-1 letter vectors, permuted by their place in the n-gram and multiplied."""

    def __init__(self, dimensions: int):
        self.dimensions, self.letters = dimensions, {}
        self.forget()

    def forget(self) -> None:
        """Sorted codes, the row of each, and the rows in the order they came, with room for more."""
        self.codes, self.places, self.rows = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((1024, self.dimensions), np.float32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng([7, point]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return self.letters[point]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """A row for each code; ``codes`` are sorted and distinct."""
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        if not known.all():
            new = codes[~known]
            made = np.empty((len(new), self.dimensions), np.float32)
            for i, code in enumerate(new.tolist()):
                made[i] = (np.roll(self.letter(code >> 42), 2) * np.roll(self.letter(code >> 21 & 0x1FFFFF), 1) * self.letter(code & 0x1FFFFF))
            if len(self.codes) > REMEMBERED:
                self.forget()
                return self.of(codes)
            n = len(self.codes)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[n:n + len(new)] = made
            every = np.concatenate([self.codes, new])
            order = np.argsort(every, kind="stable")
            self.codes, self.places = every[order], np.concatenate([self.places, np.arange(n, n + len(new))])[order]
            at = np.searchsorted(self.codes, codes)
        return self.rows[self.places[at]]


def _learner(dimensions: int):
    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, sums = Vectors(dimensions), {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                for start in range(0, len(texts), 500):
                    codes, counts = np.unique(np.concatenate([grams(x) for x in texts.iloc[start:start + 500]]), return_counts=True)
                    total = sums.setdefault(lang, np.zeros(dimensions, np.int64))
                    for i in range(0, len(codes), 50_000):
                        total += np.rint(counts[i:i + 50_000].astype(np.float64) @ vectors.of(codes[i:i + 50_000])).astype(np.int64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [x.tolist() for x in sums.values()]})

    return learn


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A prototype for each lang: the sum of the vectors of all n-grams of all its texts. Tasks sum first, so one
    short row for each task and lang is shuffled. Rows with a null text or lang are left out."""
    sums = (labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
            .mapInPandas(_learner(dimensions), "lang string, v array<bigint>")
            .select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.col("v.x").alias("v")))
    rows = sums.limit(MOST_LANGUAGES + 1).collect()  # a row for each language
    if len(rows) > MOST_LANGUAGES:
        raise ValueError("too many lang values")
    return {r.lang: np.array(r.v, np.float64) for r in sorted(rows, key=lambda r: r.lang)}


def _predictor(prototypes: dict[str, np.ndarray], dimensions: int):
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, names = Vectors(dimensions), list(prototypes)
        unit = np.array([p / (np.linalg.norm(p) or 1.0) for p in prototypes.values()]).reshape(len(names), dimensions)
        for b in batches:
            langs, scores = [], []
            for text in b["text"]:
                codes, counts = np.unique(grams(text), return_counts=True)
                lang, score = "und", 0.0
                if len(codes) and names:
                    v = np.zeros(dimensions)
                    for i in range(0, len(codes), 50_000):
                        v += counts[i:i + 50_000].astype(np.float32) @ vectors.of(codes[i:i + 50_000])
                    cosines = unit @ v / (np.linalg.norm(v) or 1.0)
                    best = int(cosines.argmax())
                    lang, score = names[best], float(min(1.0, max(0.0, cosines[best])))
                langs.append(lang)
                scores.append(score)
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": langs, "score": scores})

    return predict


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language of every whole text by its cosine with the prototypes.

    Prototypes are learned from all texts with a lang whose crc32(doc_id as text) mod 5 is not 0. A text without a
    letter, a null text, or any text when nothing could be learned is "und" with score 0. A null doc_id is not held out and
    teaches like others. Equal cosines go to the first lang by name; a negative cosine scores 0. Repeated rows
    keep a row each; other columns are ignored; an empty table gives no rows.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    prototypes = learn(docs.where(~fold), dimensions)
    return docs.select("doc_id", "text", fold.alias("held_out")).mapInPandas(
        _predictor(prototypes, dimensions), "doc_id bigint, held_out boolean, lang_pred string, score double")
