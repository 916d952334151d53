"""MinHash near-duplicate documents (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import land
from markloom.llm.graph import components
from markloom.llm.minhash import bands, may_link, mix, odd_sketch, signatures

SHINGLE = 5
PERCENT = 80
BINS, ROWS = 288, 6
SKETCH_BITS = 1024
REMEMBERED = 1_000_000


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def text_words(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space."""
    return (text or "").encode("utf-8").lower().split()


def shingle_hashes(words: list[bytes], k: int, known: _Words) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i])
    return np.unique(out)


def shingle_set(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    w = text_words(text)
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)} if w else set()


SIGNED = "doc_id bigint, n_shingles bigint, low bigint, high bigint, bands array<bigint>, sketch array<bigint>"


def _signer(k: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for b in batches:
            for start in range(0, len(b), 500):
                part = b.iloc[start:start + 500]
                sets = [shingle_hashes(text_words(t), k, known) for t in part["text"]]
                sizes = np.array([*map(len, sets)])
                digests = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 2**64) for s in sets]
                low, high = (np.array([d[i] for d in digests], np.uint64).view(np.int64) for i in (1, 0))
                hashes, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                keys = bands(signatures(hashes, owners, len(sets), BINS), ROWS)
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_shingles": sizes, "low": low, "high": high,
                                    "bands": [x.tolist() if n else [] for x, n in zip(keys, sizes)],
                                    "sketch": list(odd_sketch(hashes, owners, len(sets), SKETCH_BITS))})

    return sign


def _judge(k: int, percent: int):
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, set()
        for b in batches:
            linked = []
            for a, text_a, text_b in zip(b["a"], b["text_a"], b["text_b"]):
                if a != last:
                    last, own = a, shingle_set(text_a, k)
                other = shingle_set(text_b, k)
                both = len(own & other)
                linked.append(100 * both >= percent * (len(own) + len(other) - both))
            yield b.loc[linked, ["a", "b"]]

    return judge


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets of shingles are alike enough."""
    both = (pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a"))
    return both.select("a", "b", "text_a", "text_b").mapInPandas(_judge(k, percent), "a bigint, b bigint")


def cluster(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of documents linked by the likeness of their sets of k-word shingles.

    Documents with the same set are one class, shown by its smallest doc_id. Each class has a one-permutation signature
    of 288 bins, empty bins filled from full ones, in 48 bands of 6: a pair at 0.8 is missed by all with probability 5e-7. Each
    bucket gives a star: edges from its smallest document to the others. Linked pairs are joined to components; where a
    bucket still holds several components, pairs between these are compared as well, but for those whose sizes and odd
    sketches of 1024 bits show that they differ in too many shingles; no link that a bucket shows is lost. All links are
    confirmed on the full sets.

    Null, empty and blank texts have no shingles and are their own component, kept. Repeated rows keep a row each. A doc_id
    is taken to name one text: of several, links are confirmed on the greatest. Rows with a null doc_id are compared with
    nothing: their component_id is null and they are kept. Other columns are ignored; an empty table gives no rows.
    """
    base = docs.select("doc_id", "text")
    signed = land(base.mapInPandas(_signer(k), SIGNED), "signed")
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = land(real.groupBy("low", "high").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size")), "classes")
    reps = land(real.join(classes.select("rep"), F.col("doc_id") == F.col("rep")).groupBy("rep")
            .agg(F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "reps")
    members = reps.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    stars = members.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").drop("last")
    shared = land(members.join(stars, "bucket"), "buckets")
    alike = F.expr(f"100 * least(size_a, n_shingles) >= {percent} * greatest(size_a, n_shingles)")
    sizes = classes.groupBy("rep").agg(F.max("size").alias("size"))
    firsts = (shared.where("a != rep").select("a", F.col("rep").alias("b"), "n_shingles").distinct()
              .join(sizes.select(F.col("rep").alias("a"), F.col("size").alias("size_a")), "a").where(alike).select("a", "b"))
    firsts = land(firsts.distinct(), "stars")
    in_pairs = shared.select(F.col("rep")).distinct()
    texts = land(base.join(in_pairs, F.col("doc_id") == F.col("rep")).groupBy("rep").agg(F.max("text").alias("text")), "texts")
    linked = land(confirm(firsts, texts, k, percent), "links")
    found = components(linked)

    # Buckets with several components: what the star left open.
    named = shared.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = named.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("bucket")
    open_ = land(named.join(split, "bucket").join(reps.select("rep", "sketch"), "rep").select("bucket", "rep", "n_shingles", "component", "sketch"), "open")
    x, y = open_.alias("x"), open_.alias("y")
    rest = (x.join(y, F.expr("x.bucket = y.bucket AND x.component < y.component") & may_link("x", "y", "n_shingles", SKETCH_BITS, percent))
            .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
            .join(firsts, ["a", "b"], "left_anti"))
    more = land(confirm(rest, texts, k, percent), "more")
    final = components(linked.union(more))
    of_class = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("low", "high", F.coalesce("component", "rep").alias("component"))
    per_doc = (signed.join(of_class, ["low", "high"], "left")
               .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))))
    return per_doc.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
                          F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
