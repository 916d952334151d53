"""Toxicity by boosted trees over dense features, calibrated (operator 12)."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import land

#: Labelled documents that learning takes, drawn by a hash, in expectation.
FIT_ROWS = 200_000
#: Terms of the lexicon, and the least weight of one.
LEXICON, LEAST_WEIGHT = 2000, 1.0
#: Deviations by which a term's log ratio is lowered, so that rare terms weigh little.
CAUTION = 1.0
TREES, DEPTH = 30, 3
#: Beginnings of words that are terms as well, by their letters.
PREFIXES = (4, 5)
#: Words between a term and an address to the reader.
NEAR = 5
#: Words that a task remembers, and terms that it counts before it gives them on.
REMEMBERED = 500_000

# Words that address the reader, and characters that stand for letters.
ADDRESS = {"you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes",
           "vous", "votre", "ti", "usted", "ustedes", "vosotros"}
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

FEATURES = ["log_words", "term_density", "weight_density", "top_weight", "second_weight", "third_weight", "log_distinct_terms", "address_density",
            "near_share", "capital_share", "capital_words", "exclamations", "questions", "other_marks", "symbols", "disguised_words",
            "stretched_words", "disguised_terms"]

_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]+")
_STRETCH = re.compile(r"(.)\1{2,}")


def plain(token: str) -> tuple[str, bool, bool]:
    """A token in lower case without marks around it; letters for digits and marks inside it, and runs of three or more letters as
    one. Also whether it was disguised and whether it was stretched."""
    word = token.lower()
    if not word.isalpha():
        word = _OUTER.sub("", word)
    disguised = stretched = False
    if not word.isalpha() and any(map(str.isalpha, word)):
        core = _INNER.sub("", _OUTER.sub("", token.lower().translate(DISGUISE)) if not word.isalpha() else word)
        disguised, word = core != word, core
    if len(word) > 3 and _STRETCH.search(word):
        stretched, word = True, _STRETCH.sub(r"\1", word)
    return word, disguised, stretched


def terms(word: str) -> list[str]:
    """A word and its beginnings, marked as such."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)] if word else []


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each half and term the documents and the toxic documents that have it, as far as a task has seen; "" counts the documents."""
    def given(seen: dict[tuple[int, str], list[int]]) -> pa.RecordBatch:
        halves, found = zip(*seen)
        return pa.RecordBatch.from_arrays([pa.array(halves, pa.int32()), pa.array(found, pa.string()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in (0, 1))],
                                          names=["half", "term", "n", "toxic"])

    seen: dict[tuple[int, str], list[int]] = {}
    for b in batches:
        for half, text, toxic in zip(*(c.to_pylist() for c in b.columns)):
            words = {plain(t)[0] for t in set((text or "").split())}
            for term in {"", *(t for w in words for t in terms(w))}:
                counts = seen.setdefault((half, term), [0, 0])
                counts[0] += 1
                counts[1] += toxic
            if len(seen) > REMEMBERED:
                yield given(seen)
                seen = {}
    if seen:
        yield given(seen)


def learn_lexicons(labelled: DataFrame, size: int = LEXICON) -> list[dict[str, float]]:
    """Three lexicons of labelled rows (half 0 or 1, text, toxic 0 or 1): without half 0, without half 1, and of all.

    A lexicon has the ``size`` terms that tell toxic documents most surely, with their weights: the log ratio of the shares of toxic
    and of other documents that have the term, less some deviations.
    """
    counts = land(labelled.select("half", "text", "toxic").mapInArrow(_counter, "half int, term string, n bigint, toxic bigint")
                  .groupBy("half", "term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")), "terms")
    out = []
    for part in (counts.where("half != 0"), counts.where("half != 1"), counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))):
        every = part.where("term = ''").collect()
        if not every or every[0].toxic in (0, every[0].n):
            out.append({})
            continue
        bad, good = every[0].toxic, every[0].n - every[0].toxic
        t, c = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
        weight = F.log(t / (bad + 1)) - F.log(c / (good + 1)) - CAUTION * F.sqrt(1 / t + 1 / c)
        best = (part.where("term != '' AND toxic > 1").select("term", weight.alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
                .orderBy(F.desc("weight"), "term").limit(size))
        out.append({r.term: r.weight for r in best.collect()})
    return out


class _Words(dict):
    """A token to the row of its facts: its weight, whether it is an address, in capitals, disguised, stretched (bits), and the number of its term."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.terms = lexicon, {}
        self.weight, self.marks, self.term = array("d"), array("b"), array("l")

    def __missing__(self, token: str) -> int:
        word, disguised, stretched = plain(token)
        weight = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        self.weight.append(weight)
        self.marks.append((word in ADDRESS) | (len(word) > 1 and token.isupper()) << 1 | disguised << 2 | stretched << 3)
        self.term.append(self.terms.setdefault(word, len(self.terms)) if weight else -1)
        self[token] = out = len(self.weight) - 1
        return out


def _distance(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For sorted places, how far each is from the nearest of ``to``."""
    right = np.searchsorted(to, at)
    ends = np.concatenate([[-1 << 40], to, [1 << 40]])
    return np.minimum(at - ends[right], ends[right + 1] - at)


_MARKS = {name: np.frombuffer(marks, np.uint8) for name, marks in (("!", b"!"), ("?", b"?"), ("other", b".,;:'\"-()"), ("symbols", b"#*$%&|<>@^~_=+"))}


def features(text: str | None, words: _Words) -> list[float]:
    """The values of FEATURES for a text; shares are of its words or of its bytes, and 0 in an empty text."""
    text = text or ""
    tokens = text.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    rows = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    weight, marks, term = (np.frombuffer(x, kind)[rows] for x, kind in ((words.weight, np.float64), (words.marks, np.int8), (words.term, np.int64)))
    n, hit = len(tokens), weight > 0
    own, first = np.unique(term[hit], return_index=True)
    top = np.sort(weight[hit][first])[::-1][:3].tolist() + [0.0] * 3
    near = 0.0
    at, to = np.flatnonzero(hit), np.flatnonzero(marks & 1)
    if len(at) and len(to):
        near = float((_distance(at, to) <= NEAR).mean())
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = raw.sum()
    share = [float(np.count_nonzero(marks & bit) / n) for bit in (1, 2, 4, 8)]
    return [float(np.log1p(n)), float(len(at) / n), float(weight.sum() / n), *top[:3], float(np.log1p(len(own))), share[0],
            near, raw[65:91].sum() / size, share[1], *(raw[m].sum() / size for m in _MARKS.values()),
            share[2], share[3], float(np.count_nonzero(marks[at] & 12) / max(1, len(at)))]


def _extractor(lexicon: dict[str, float]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(lexicon)
        for b in batches:
            found = []
            for text in b.column(-1):
                if len(words) > REMEMBERED:
                    words = _Words(lexicon)
                found.append(features(text.as_py(), words))
            flat = np.array(found, np.float64).reshape(len(found), len(FEATURES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(FEATURES), pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*b.schema.names[:-1], "features"])

    return extract


def dense(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """The columns before ``text``, which comes last, and the features."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(_extractor(lexicon), f"{fields}, features array<double>")
    return out.withColumn("features", array_to_vector("features"))


@dataclass
class Model:
    """Without a lexicon or trees (labels of one kind only) every text scores ``prior``."""

    prior: float
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None = None
    steps: IsotonicRegressionModel | None = None


def _has_both(rows: DataFrame) -> bool:
    r = rows.agg(F.min("toxic").alias("a"), F.max("toxic").alias("b")).collect()[0]
    return r.a == 0 and r.b == 1


def learn(sample: DataFrame, seed: int = 1) -> Model:
    """Learn from rows (fold, text, toxic): the lexicon and the trees from folds other than 1, the steps of the
    calibration from fold 1, or from all where fold 1 has labels of one kind only."""
    facts = sample.agg(F.count("*").alias("n"), F.avg("toxic").alias("prior")).collect()[0]
    if not facts.n or facts.prior in (0.0, 1.0):
        return Model(facts.prior or 0.0, {})
    sample = sample.withColumn("half", F.pmod(F.xxhash64("text", F.lit(seed + 1)), F.lit(2)).cast("int"))
    taught = sample.where("fold != 1")
    *others, lexicon = learn_lexicons(taught)
    # What teaches the trees is measured with the lexicon of the other half, as its own words would look too telling.
    parts = [dense(taught.where(F.col("half") == i).select("fold", "toxic", "text"), own) for i, own in enumerate(others)]
    rows = land(parts[0].union(parts[1]).union(dense(sample.where("fold = 1").select("fold", "toxic", "text"), lexicon)), "features")
    teach, steady = rows.where("fold != 1"), rows.where("fold = 1")
    if not _has_both(teach):
        return Model(facts.prior, lexicon)
    trees = GBTClassifier(labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=seed, maxBins=64).fit(teach)
    raw = trees.transform(steady if _has_both(steady) else rows).select(vector_to_array("probability")[1].alias("raw"), F.col("toxic").cast("double").alias("toxic"))
    return Model(facts.prior, lexicon, trees, IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(raw))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """The columns before ``text``, which comes last, with score (0 to 1) and predicted (1 from 0.5)."""
    kept = rows.columns[:-1]
    if model.trees is None:
        out = rows.select(*kept, F.lit(model.prior).cast("double").alias("score"))
    else:
        out = model.trees.transform(dense(rows, model.lexicon)).select(*kept, vector_to_array("probability")[1].alias("raw"))
        out = model.steps.setPredictionCol("stepped").transform(out).select(*kept, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "stepped")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    Labels are learned only from documents whose crc32(doc_id as text) mod 5 is not 0. Terms of a learned lexicon are words and
    beginnings of words; the features are their density and weights, how near they are to words that address the
    reader, and rates of capitals, marks, symbols and disguised or stretched words. Boosted trees over these are calibrated by
    isotonic regression on a fold that taught nothing else. ``fit_rows`` bounds the labels that are used, in expectation.

    Nulls: a null text is an empty one and scored like it; a null doc_id has no label and is not held out; null labels are left
    out. Of several labels of a document the greatest counts. Repeated rows keep a row each; other columns are ignored. Without
    labels of both kinds all texts score the share of label 1 (0 without labels). An empty table gives no rows.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    one = labels.where("toxic IN (0, 1)").groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").cast("int").alias("toxic"))
    # At most some fit_rows labels are drawn, so they are small enough to be sent to the texts.
    teach = one.where(F.crc32(F.col("of").cast("string")) % 5 != 0)
    share = min(1.0, fit_rows / max(1, teach.count()))
    drawn = teach.where(F.pmod(F.xxhash64("of"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("of")).select(fold.cast("int").alias("fold"), "text", "toxic")
    model = learn(sample)
    return score(docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text"), model)
