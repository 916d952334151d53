"""Mixing sources to target weights (operator 2)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window as W

from markloom.llm.common import SPACE, land, let

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 64
SHARDS = 64
MOST_PASSES = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> list[float]:
    """Words to take of each source: shares by the repeating weights, at most ``most`` times a source's size, the excess
    shared again by weight among the rest until none is above."""
    total, share = float(sum(sizes)), [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n]
    left = total
    while open_:
        unit = left / sum(share[i] for i in open_)
        full = [i for i in open_ if unit * share[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else unit * share[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in full] if full else []
    return out


@F.pandas_udf(LongType())
def permuted(slot: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    """The place of ``slot`` under a pseudorandom permutation of 0..n-1 that belongs to ``seed``.

    Four Feistel rounds over a square a little larger than n; a place outside is sent through again.
    """
    x, n, seed = slot.to_numpy(np.uint64), n.to_numpy(np.uint64), seed.to_numpy(np.int64).view(np.uint64)
    side = np.ceil(np.sqrt(n.astype(np.float64))).astype(np.uint64)
    side += (side * side < n).astype(np.uint64)

    def walk(x: np.ndarray, side: np.ndarray, seed: np.ndarray) -> np.ndarray:
        left, right = x // side, x % side
        for turn in range(4):
            h = (right + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ seed
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            left, right = right, (left + (h ^ (h >> np.uint64(31))) % side) % side
        return left * side + right

    at = np.flatnonzero(np.ones(len(x), bool))
    while len(at):
        x[at] = walk(x[at], side[at], seed[at])
        at = at[x[at] >= n[at]]
    return pd.Series(x.astype(np.int64))


@dataclass
class Mix:
    """``sources``: source, source_size, target, n_full (whole blocks), n_blocks, n_slots, last_words (of the last slot), draws
    (slots of each shard). ``places``: llm_doc_key, doc_id, source, size, offset of its first word in its source's stream.
    ``slots``: shard, source, slot, pass, block, length (words taken from the block's start)."""

    sources: DataFrame
    places: DataFrame
    slots: DataFrame


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shards: int = SHARDS, seed: int = 1,
        key: Column | None = None) -> Mix:
    """Draw the blocks of a mix of all documents by source.

    Each source's documents are packed end to end and cut into blocks of ``block`` words (the last may be shorter).
    A source gets as many slots as its target needs, and the last slot takes the words that are still wanted: the words
    taken are the target, rounded. How many slots of a source lie in each output shard is a multinomial draw of that total;
    a shard's slots follow those of the shard before. Slot j takes, in pass j div n, the block at place j mod n of that
    pass's permutation of the whole blocks, the shorter one coming last, so no block is taken more than three times.
    All draws depend on seed, source and slot alone: reruns agree.

    Nulls: a null text has size 0, a null source is a source of its own, last in order; null and repeated doc_ids
    keep a row each. A source of size 0 has target 0. An empty table gives no rows. The sources are ranked on the
    driver: their number is taken to be small (thousands), as it is the number of weights; documents never are.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), (F.xxhash64("doc_id", "text") if key is None else key).alias("llm_doc_key"))
    sized = land(sized, "sizes")
    # Sizes are summed within pieces of each source, then over the pieces: no source meets in one task.
    rows = sized.count()
    pieces = max(1, round(rows ** 0.5))
    piece = F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).alias("piece")
    inner = W.partitionBy("source", "piece").orderBy("doc_id", "llm_doc_key").rowsBetween(W.unboundedPreceding, -1)
    within = sized.select("*", piece).withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    sums = sized.groupBy("source", piece).agg(F.sum("size").alias("words"))
    outer = W.partitionBy("source").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("piece").alias("p"), F.coalesce(F.sum("words").over(outer), F.lit(0)).alias("start"))
    places = (within.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p")))
              .select("llm_doc_key", "doc_id", "source", "size", (F.col("start") + F.col("before")).alias("offset")))

    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()  # one row a source
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    sizes = [r.n for r in totals]
    plan = []
    for i, (r, target) in enumerate(zip(totals, targets(sizes, weights))):
        n = -(-r.n // block)
        passes = int(target // r.n) if r.n else 0
        rest = round(target - passes * r.n)
        more = -(-rest // block)
        draws = np.random.default_rng([seed, i]).multinomial(passes * n + more, [1 / shards] * shards).tolist()
        plan.append((r.source, r.n, target, r.n // block, n, passes * n + more, rest - (more - 1) * block if more else block, draws))
    sources = spark.createDataFrame(plan, "source string, source_size bigint, target double, n_full bigint, n_blocks bigint, n_slots bigint,"
                                    " last_words bigint, draws array<bigint>")
    per_task = 100_000
    dealt = sources.select("*", F.posexplode("draws").alias("shard", "drawn")).where("drawn > 0").select(
        "*", F.expr("aggregate(slice(draws, 1, shard), 0L, (a, x) -> a + x)").alias("start"))
    ranges = dealt.select("shard", "source", "n_full", "n_blocks", "n_slots", "last_words", (F.col("start") + F.col("drawn")).alias("stop"),
                          F.explode(F.sequence("start", F.col("start") + F.col("drawn") - 1, F.lit(per_task).cast("bigint"))).alias("first"))
    slot = F.explode(F.sequence("first", F.least(F.col("first") + per_task, "stop") - 1)).alias("slot")
    tasks = sum(p[5] // per_task + 1 for p in plan) or 1
    slots = ranges.repartition(tasks, "source", "first").select("shard", "source", "n_full", "n_blocks", "n_slots", "last_words", slot)
    slots = slots.withColumns({"pass": F.expr("slot div n_blocks"), "place": F.col("slot") % F.col("n_blocks")})
    whole = permuted(F.least("place", F.greatest(F.col("n_full") - 1, F.lit(0))), F.greatest("n_full", F.lit(1)),
                     F.xxhash64(F.lit(seed), "source", "pass"))
    slots = slots.select(
        "shard", "source", "slot", "pass", F.when(F.col("place") < F.col("n_full"), whole).otherwise(F.col("n_full")).alias("block"),
        F.when(F.col("slot") == F.col("n_slots") - 1, F.col("last_words")).otherwise(F.lit(block)).cast("bigint").alias("length"))
    return Mix(sources, places, slots)


def _pieces(places: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document has words in: words from..to (exclusive) of the document."""
    last = F.floor((F.col("offset") + F.col("size") - 1) / block)
    return (places.where("size > 0")
            .select("*", F.explode(F.sequence(F.floor(F.col("offset") / block), last)).alias("block"))
            .withColumns({"from": F.greatest(F.col("block") * block - F.col("offset"), F.lit(0)),
                          "to": F.least((F.col("block") + 1) * block - F.col("offset"), "size")}))


def _end(block: int) -> Column:
    """End of a piece within a slot that takes ``length`` words of its block; not before the piece's start."""
    return F.greatest("from", F.least("to", F.col("block") * block + F.col("length") - F.col("offset")))


def taken_words(m: Mix, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken: for every document, the words that the mix takes of it."""
    # The slots come from a few rows, so their number is underestimated: they must not be broadcast.
    counts = m.slots.groupBy(F.col("source").alias("s"), F.col("block").alias("b"), "length").agg(F.count("*").alias("times")).hint("merge")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    taken = (_pieces(m.places, block).join(counts, same).withColumn("to", _end(block)).groupBy("doc_id", "llm_doc_key")
             .agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken")))
    d = m.places.alias("d")
    # Equal rows (same id and text) are counted together and shared out evenly.
    twins = m.places.groupBy("doc_id", "llm_doc_key").agg(F.count("*").alias("n"))
    each = taken.alias("t").join(twins.alias("w"), F.expr("t.doc_id <=> w.doc_id AND t.llm_doc_key = w.llm_doc_key")).select(
        "t.doc_id", "t.llm_doc_key", (F.col("t.taken") / F.col("w.n")).cast("bigint").alias("taken"))
    return (d.join(each.alias("t"), F.expr("d.doc_id <=> t.doc_id AND d.llm_doc_key = t.llm_doc_key"), "left")
            .join(m.sources.alias("s"), F.expr("d.source <=> s.source"))
            .select("d.doc_id", "d.size", "s.source_size", "s.target", F.coalesce("t.taken", F.lit(0)).cast("bigint").alias("taken")))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """The mix as documents: for each pass, the words that it takes of a document, as one row with the columns of ``docs``.

    Of rows that are equal in all columns, each has a place in its source's stream and gives the words taken there, as one of them.
    White space before a word stays with it. Texts without a word are in no block and are not in the mix. n_chars, where
    there is such a column, is counted anew.
    """
    key = F.xxhash64(*docs.columns)
    m = mix(docs, weights, block, seed=seed, key=key)
    slots = m.slots.select(F.col("source").alias("s"), F.col("block").alias("b"), "pass", "length").hint("merge")
    runs = (_pieces(m.places, block).join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
            .withColumn("to", _end(block)).where(F.col("to") > F.col("from"))
            .groupBy("llm_doc_key", "source", "offset", "pass").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("runs")))
    all_words = F.regexp_extract_all("text", F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0))
    cut = let(all_words, lambda w: F.concat_ws("", F.flatten(F.transform("runs", lambda r: F.slice(
        w, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int"))))))
    keyed = docs.withColumn("llm_doc_key", key).dropDuplicates(["llm_doc_key"])
    out = (keyed.alias("d").join(runs.alias("r"), F.expr("d.llm_doc_key = r.llm_doc_key"))
           .select("d.*", "r.runs").withColumn("text", cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def shard_blocks(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shards: int = SHARDS, seed: int = 1) -> DataFrame:
    """The mix as it is written out: shard, place (0, 1, ... within shard and source), source, slot, words (the text of the slot's block).

    A block holds at most ``block`` words, from one or more documents that follow each other; only the last of a source's
    stream and the last slot of a source are shorter. Nulls, empty texts and equal rows as in ``mix``.
    """
    key = F.xxhash64("source", "text")
    m = mix(docs, weights, block, shards, seed, key)
    texts = docs.select(key.alias("llm_doc_key"), "text").dropDuplicates(["llm_doc_key"])
    at = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("offset") + F.col("size") - 1) / block) - F.floor(F.col("offset") / block))
    cuts = F.transform(at, lambda i: F.floor(F.col("offset") / block) + i)
    piece = lambda w: F.transform(cuts, lambda b: F.struct(
        b.alias("block"), F.greatest(b * block, "offset").alias("at"),
        F.slice(w, (F.greatest(b * block - F.col("offset"), F.lit(0)) + 1).cast("int"),
                (F.least((b + 1) * block, F.col("offset") + F.col("size")) - F.greatest(b * block, "offset")).cast("int")).alias("w")))
    found = F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+"), F.lit(0))
    pieces = (m.places.where("size > 0").join(texts, "llm_doc_key").select("source", F.explode(let(found, piece)).alias("p"))
              .select("source", "p.block", "p.at", "p.w"))
    slots = m.slots.select("shard", F.col("source").alias("s"), "slot", F.col("block").alias("b"), "length").hint("merge")
    kept = F.greatest(F.lit(0), F.least(F.size("w"), F.col("b") * block + F.col("length") - F.col("at"))).cast("int")
    rows = pieces.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select(
        "shard", "source", "slot", "at", F.slice("w", F.lit(1), kept).alias("w"))
    starts = m.sources.select(F.col("source").alias("s"), F.posexplode("draws").alias("sh", "drawn"), "draws").select(
        "s", "sh", F.expr("aggregate(slice(draws, 1, sh), 0L, (a, x) -> a + x)").alias("start"))
    joined = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"])), " ")
    out = rows.groupBy("shard", "source", "slot").agg(joined.alias("words"))
    return (out.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("sh")))
            .select("shard", (F.col("slot") - F.col("start")).alias("place"), "source", "slot", "words"))
