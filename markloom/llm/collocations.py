"""Phrase collocation mining with an FM-index per shard (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from markloom.llm.common import land
from markloom.llm.minhash import mix

#: Characters that end a piece.
BREAKS = ".,;:!?\n\x0b\x0c\r"
MOST_WORDS = 5
LEAST_COUNT = 100
#: Words of a shard; a text is never cut, so a shard may be longer by one text.
SHARD_WORDS = 1_000_000
#: Bytes of texts that are cut into words at once.
CHUNK_BYTES = 1_000_000
#: Bits of the filter of known phrases.
FILTER_BITS = 1 << 26
#: One byte to one: A-Z to lower case, tabs to blanks, the end of a piece to a line feed.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + BREAKS.encode(), b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(BREAKS))

SHARDS = "text binary, vocabulary array<struct<lang: string, word: string, n: bigint>>"


class _Symbols(dict):
    """Numbers of the words of one language; all languages of a shard share one list, so equal words of two languages differ."""

    def __init__(self, lang: str | None, names: list):
        super().__init__({b"": -1, b"\n": 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.lang, word))
        self[word] = out = len(self.names)
        return out


def _cut(limit: int):
    """Texts to shards: the symbol of each word, 0 between pieces, and the words with their counts."""

    def shard(parts: list[np.ndarray], names: list) -> pa.RecordBatch:
        text = np.concatenate([*parts, np.zeros(1, np.int32)])
        counts = np.bincount(text, minlength=len(names) + 1)[1:]
        langs, words = zip(*names) if names else ((), ())
        entries = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                                             names=["lang", "word", "n"])
        lists = pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)
        return pa.RecordBatch.from_arrays([pa.array([text.tobytes()], pa.binary()), lists], names=["text", "vocabulary"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, names, symbols, total = [], [], {}, 0
        for b in batches:
            for lang, texts in _runs(b):
                known = symbols.get(lang) if lang in symbols else symbols.setdefault(lang, _Symbols(lang, names))
                found = (b"\n" + texts).translate(LOWER).replace(b"\n", b" \n ").split(b" ")
                codes = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
                codes = codes[codes >= 0]
                parts.append(codes)
                total += len(codes)
                if total >= limit:
                    yield shard(parts, names)
                    parts, names, symbols, total = [], [], {}, 0
        if parts:
            yield shard(parts, names)

    return cut


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str | None, bytes]]:
    """(lang, texts): texts of one language, with breaks between them, of some CHUNK_BYTES."""
    held: dict[str | None, list[bytes]] = {}
    size = 0
    for lang, text in zip(batch.column(0), batch.column(1)):
        if text.as_py():
            held.setdefault(lang.as_py(), []).append(text.as_py().encode())
            size += len(held[lang.as_py()][-1])
            if size >= CHUNK_BYTES:
                yield from ((k, b"\n".join(v)) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def stable_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of numbers from 0, sorted by digits of 16 bits."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    high, shift = int(keys.max(initial=0)) >> 16, 16
    while high:
        order = order[np.argsort((keys[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        high, shift = high >> 16, shift + 16
    return order.astype(np.int32)


def expand(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all intervals, one after the other."""
    out = np.repeat((lo - (np.cumsum(size) - size)).astype(np.int32), size)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Half:
    """An index of a text in one direction: the Burrows-Wheeler transform of its suffixes, sorted by their first ``depth`` words.

    The text begins and ends with a break (0). The suffixes that begin with a phrase of up to ``depth`` words are an interval.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = np.concatenate([text, np.zeros(depth, text.dtype)]), depth
        self.suffixes = np.arange(len(text), dtype=np.int32)
        for offset in reversed(range(depth)):
            self.suffixes = self.suffixes[stable_order(self.text[self.suffixes + offset])]
        self.first = text[self.suffixes]
        before = stable_order(text[self.suffixes - 1])  # the transform: the word before each suffix
        #: Where the suffix that is one word longer stands: the number of smaller words, and of equal ones before it.
        self.longer = np.empty(len(text), np.int32)
        self.longer[before] = np.arange(len(text))

    def intervals(self, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(lo, size) of the phrases of ``depth`` words that begin at the places ``at`` of the text."""
        new = np.zeros(len(self.suffixes), bool)
        new[0] = True
        for offset in range(depth):
            word = self.text[self.suffixes + offset]
            new[1:] |= word[1:] != word[:-1]
        starts = np.flatnonzero(new)
        place = np.empty(len(self.suffixes), np.int32)
        place[self.suffixes] = np.cumsum(new) - 1
        own = place[at]
        return starts[own], np.diff(np.append(starts, len(new)))[own]

    def extend(self, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions of disjoint intervals by the word before: (interval, word, lo, size, how many suffixes of the interval
        have a smaller word before). Breaks count as word 0."""
        owner = np.full(len(self.first), -1, np.int32)
        owner[self.longer[expand(lo, size)]] = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        spot = np.flatnonzero(owner >= 0)
        group, word = owner[spot], self.first[spot]
        new = np.ones(len(spot), bool)
        new[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        begin = np.flatnonzero(new)
        group, word, start, count = group[begin], word[begin], spot[begin], np.diff(np.append(begin, len(spot)))
        order = stable_order(group)  # by interval, then by word
        running = np.cumsum(count[order]) - count[order]
        smaller = np.empty(len(order), np.int64)
        smaller[order] = running - (np.cumsum(size) - size)[group[order]]
        return group, word, start, count, smaller


def longer_phrases(text: np.ndarray, depth: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of ``depth`` + 1 words of which both phrases of ``depth`` words are given, by places ``at`` where given ones begin, one or more of each.

    Intervals in the index of the text and in that of its reverse are kept together: an extension to the left is a step in the
    one and narrows the other. Returns a place and the count of each phrase that a left extension of a given phrase and a right
    extension of a given phrase both reach.
    """
    ahead, back = Half(text, depth + 1), Half(text[::-1], depth + 1)
    lo, size = ahead.intervals(at, depth)
    lo, one = np.unique(lo, return_index=True)
    size = size[one]
    back_lo, _ = back.intervals(len(text) - at[one] - depth, depth)
    _, word, start, count, _ = ahead.extend(lo, size)
    prefix, last, _, _, smaller = back.extend(back_lo, size)
    reached = np.zeros(len(text), bool)
    reached[(lo[prefix] + smaller)[last > 0]] = True
    keep = (word > 0) & reached[start]
    return ahead.suffixes[start[keep]], count[keep]


def compact(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text with runs of breaks as one, and the new place of each old one; it begins and ends with a break."""
    keep = text != 0
    keep[1:] |= text[:-1] != 0
    keep[0] = True
    return text[keep], np.cumsum(keep) - 1


def bits_of(words: list[np.ndarray]) -> np.ndarray:
    """The bit of a filter that stands for a phrase, from the numbers of its words."""
    h = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64))
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = np.zeros(FILTER_BITS // 8, np.uint8)
    with np.errstate(over="ignore"):
        for b in batches:
            at = bits_of([c.to_numpy() for c in b.columns])
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
    longs = own.view(np.int64)
    full = np.flatnonzero(longs)
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(longs[full])], names=["place", "bits"])


def phrase_filter(phrases: DataFrame) -> np.ndarray:
    """A filter of fixed size that has the bit of every phrase (columns: the numbers of the words) and few others."""
    found = phrases.mapInArrow(_mark, "place int, bits bigint").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["place"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def _number(shards: pa.Table, frequent: pa.Table) -> pa.Table:
    """A shard with frequent words numbered from 1 and all others as breaks, and the number of each over all shards."""
    text, words = np.zeros(1, np.int32), np.full(1, -1)
    if shards.num_rows and frequent.num_rows:
        raw = np.frombuffer(shards["text"][0].as_buffer(), np.int32)
        symbols = frequent["symbol"].to_numpy()
        number = np.zeros(max(raw.max(), symbols.max()) + 1, np.int32)
        number[symbols] = np.arange(1, len(symbols) + 1)
        text = np.concatenate([np.zeros(1, np.int32), number[raw], np.zeros(1, np.int32)])
        text[1:-1][(text[:-2] == 0) & (text[2:] == 0)] = 0  # a word alone has no phrase
        text, _ = compact(text)
        words = np.concatenate([words, frequent["id"].to_numpy()])
    return pa.table({"text": pa.array([text.tobytes()], pa.binary()), "words": pa.array([words.tobytes()], pa.binary())})


def _extender(size: int, known: Broadcast | None):
    """Counts of the phrases of ``size`` words in each shard, from those one word shorter that the filter lets pass."""
    def begun(text: np.ndarray, words: np.ndarray, bits: np.ndarray) -> np.ndarray:
        last = len(text) - size + 2  # of all places, those where such a shorter phrase begins
        parts = [text[i:last + i] for i in range(size - 1)]
        at = np.flatnonzero(np.all([p > 0 for p in parts], axis=0))
        bit = bits_of([words[p[at]] for p in parts])
        return at[bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(f"w{i}" for i in range(size)), "n"]
        for b in batches:
            for row in range(b.num_rows):
                text, words = np.frombuffer(b.column(0)[row].as_buffer(), np.int32), np.frombuffer(b.column(1)[row].as_buffer(), np.int64)
                symbols, at = np.unique(text, return_index=True)  # of all words a place is enough
                at = at[symbols > 0]
                if known is not None and len(at):
                    with np.errstate(over="ignore"):
                        at = begun(text, words, known.value)
                    cover = np.zeros(len(text) + 1, np.int32)
                    cover[at] += 1
                    np.subtract.at(cover, at + size - 1, 1)
                    text, place = compact(np.where(np.cumsum(cover[:-1]) > 0, text, 0))
                    at = place[at]
                if not len(at):
                    continue
                at, count = longer_phrases(text, size - 1, at)
                for start in range(0, len(at), 200_000):
                    part = at[start:start + 200_000]
                    yield pa.RecordBatch.from_arrays([*(pa.array(words[text[part + i]]) for i in range(size)), pa.array(count[start:start + 200_000], pa.int64())], names=names)

    return extend


def phrase_counts(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``most_words`` words that occur at least ``least`` times in a language, and the words of each language.

    Returns (lang, size, phrase, f) and (lang, n). A task cuts texts into shards of some million words. Each step extends,
    in every shard, the phrases that are frequent over all shards by a word to the left and to the right in a
    bidirectional index; counts are summed over shards. A phrase is as frequent as its parts at most, so nothing is lost.
    The tasks of a step know the phrases of the step before by a filter of a fixed 8 MB, the only data that is broadcast: a phrase that it
    lets pass wrongly costs work but is counted like any other. Keys are exact: the numbers of the words.
    """
    lang = F.coalesce("lang", F.lit("und")).alias("lang")
    shards = land(docs.select(lang, "text").mapInArrow(_cut(shard_words), SHARDS).select(F.monotonically_increasing_id().alias("shard"), "*"), "shards")
    parts = max(1, -(-shards.count() // 2))
    entries = shards.select("shard", F.posexplode("vocabulary").alias("place", "v")).select("shard", (F.col("place") + 1).alias("symbol"), "v.*")
    words = land(entries.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    one = land(words.where(F.col("f") >= least).select(F.monotonically_increasing_id().alias("id"), "lang", "word", "f"), "frequent")
    marked = entries.join(one.select("lang", "word", "id"), ["lang", "word"]).select(F.col("shard").alias("of"), "symbol", "id")
    numbered = land(shards.select("shard", "text").repartition(parts, "shard").groupBy("shard")
                    .cogroup(marked.repartition(parts, "of").groupBy("of")).applyInArrow(_number, "text binary, words binary"), "numbered")
    found, known = [one.select(F.col("id").alias("w0"), "lang", F.col("word").alias("phrase"), "f")], None
    begin = one.select(F.col("id").alias("w0"), "lang", "word")
    for size in range(2, most_words + 1):
        key = [f"w{i}" for i in range(size)]
        counted = numbered.mapInArrow(_extender(size, known), ", ".join(f"{k} bigint" for k in [*key, "n"]))
        held = land(counted.groupBy(*key).agg(F.sum("n").alias("f")).where(F.col("f") >= least), f"phrases-{size}")
        rest = found[-1].select(*(F.col(f"w{i}").alias(f"w{i + 1}") for i in range(size - 1)), F.col("phrase").alias("rest"))
        found.append(land(held.join(begin, "w0").join(rest, key[1:]).select(*key, "lang", F.concat_ws(" ", "word", "rest").alias("phrase"), "f"), f"named-{size}"))
        if size < most_words:
            known = docs.sparkSession.sparkContext.broadcast(phrase_filter(held.select(*key)))
    every = None
    for size, some in enumerate(found, 1):
        some = some.select("lang", F.lit(size).alias("size"), "phrase", "f")
        every = some if every is None else every.unionByName(some)
    return every, words.groupBy("lang").agg(F.sum("f").alias("n"))


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language that hold together most.

    A phrase of 2 to ``most_words`` words that occurs a >= ``least`` times is cut in two in the way that scores least:
    score = floor(1000 * a * n / (l * r)), with l and r the counts of the parts and n the words of the language; ties go to the
    shortest first part. A phrase that lies in a longer one of the same count is dropped: one word more to the left or right
    then has that count as well. Products are decimals of 38 digits; beyond them Spark raises an error.

    Nulls: a null text has no words, a null lang is ``und``. Repeated rows count again, doc_id and other columns are ignored. No
    frequent phrase, or an empty table: no rows. One text is held whole in a task.
    """
    counts, sizes = phrase_counts(docs, most_words, least, shard_words)
    counts = land(counts, "counts")
    names = F.split("phrase", " ", -1)
    several = counts.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", names.alias("w"))
    # what one word more to the left or right has
    parts = F.array(F.array_join(F.slice("w", 1, F.col("size") - 1), " "), F.array_join(F.slice("w", 2, F.col("size") - 1), " "))
    around = several.where("size > 2").select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = several.join(around, ["lang", "phrase"], "left").where("around IS NULL OR around < a").drop("around")
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    scored = (cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
              .join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
              .join(sizes, "lang")
              .withColumn("above", (_wide(F.col("a")) * _wide(F.col("n")) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"))
              .withColumn("below", (_wide(F.col("l")) * _wide(F.col("r"))).cast("decimal(38,0)"))
              .withColumn("score", F.expr("above div below")))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return (worst.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
