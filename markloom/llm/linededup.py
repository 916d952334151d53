"""Fuzzy line dedup by MinHash (operator 4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.collocations import bits_of, phrase_filter
from markloom.llm.common import SPACE, land
from markloom.llm.graph import components
from markloom.llm.minhash import bands, may_link, mix, odd_sketch, signatures

#: Characters of a shingle; the end of a line is padded by one less, so that every line has a shingle for each character.
SHINGLE = 8
PERCENT = 80
BINS, ROWS = 64, 4
SKETCH_BITS = 1024
#: Keys in a packed row, keys for a task of the star, and rows after which it settles.
PACKED, TASK_ROWS, SETTLE_ROWS = 4096, 1_000_000, 4_000_000
PAD = "\0" * (SHINGLE - 1)


def shingle_set(line: str) -> set[str]:
    padded = line + PAD
    return {padded[i:i + SHINGLE] for i in range(len(line))}


def _shingle_hashes(part: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of some lines, and the place of the line of each."""
    points = np.frombuffer((PAD.join(part) + PAD).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    h, step = mix(points + np.uint64(1)), 1
    while step < SHINGLE:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    sizes = np.array([*map(len, part)])
    begins = np.cumsum(sizes + len(PAD)) - sizes - len(PAD)
    owner = np.repeat(np.arange(len(part)), sizes)
    at = np.arange(len(owner)) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    return mix(h[at]), owner


def _packed(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Band keys of each line, gathered by the part of a bucket: a row has up to PACKED keys and the ids beside them, as bytes.
    A line that a batch has twice is worked on once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                ids, first = np.unique(b.column(0).to_numpy(), return_index=True)
                lines = b.column(1).take(pa.array(first)).to_pylist()
                keys = []
                for start in range(0, len(lines), 2000):
                    part = lines[start:start + 2000]
                    hashes, owner = _shingle_hashes(part)
                    keys.append(bands(signatures(hashes, owner, len(part), BINS), ROWS))
                if not keys:
                    continue
                keys = np.concatenate(keys)
                owners, keys = np.repeat(ids, keys.shape[1]), keys.ravel()
                part = ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, keys, owners = part[order], keys[order], owners[order]
                begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                begins = np.unique(np.r_[begins, np.arange(0, len(part), PACKED)])
                offsets = pa.py_buffer((np.r_[begins, len(part)] * 8).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(part[begins]), *(
                    pa.Array.from_buffers(pa.binary(), len(begins), [None, offsets, pa.py_buffer(x.tobytes())]) for x in (keys, owners))],
                    names=["part", "buckets", "ids"])
    return run


def _unpacked(column: pa.BinaryArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members (bucket, id, a) of every bucket with two lines or more, a being its centre.

    The task keeps the centre of each of its buckets and whether it is given out, and the rows since the last settlement,
    so a bucket of any size passes through it in bounded memory. A member may be given out more than once.
    """
    centre = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]  # bucket, id, given out
    waiting, n = [], 0

    def settle() -> Iterator[pa.RecordBatch]:
        buckets = np.concatenate([centre[0], *(w[0] for w in waiting)])
        ids = np.concatenate([centre[1], *(w[1] for w in waiting)])
        rank = (np.arange(len(ids)) >= len(centre[0])).astype(np.int8)
        given = np.r_[centre[2], np.zeros(len(ids) - len(centre[2]), bool)]
        waiting.clear()
        order = np.lexsort((ids, rank, buckets))
        buckets, ids, given = buckets[order], ids[order], given[order]
        head = np.r_[True, buckets[1:] != buckets[:-1]][:len(ids)]
        of = np.cumsum(head) - 1
        at = np.flatnonzero(head)
        a = ids[at][of]
        leaf = ~head & (ids != a) & np.r_[True, (ids[1:] != ids[:-1]) | head[1:]][:len(ids)]
        shared = np.bincount(of[leaf], minlength=len(at)) > 0
        fresh = np.zeros(len(ids), bool)
        fresh[at] = shared & ~given[at]
        centre[:] = [buckets[at], ids[at], given[at] | shared]
        out = np.flatnonzero(leaf | fresh)
        for start in range(0, len(out), 100_000):
            x = out[start:start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(buckets[x]), pa.array(ids[x]), pa.array(a[x])], names=["bucket", "id", "a"])

    for b in batches:
        waiting.append((_unpacked(b.column(1)), _unpacked(b.column(2))))
        n += len(waiting[-1][0])
        if n >= max(SETTLE_ROWS, len(centre[0])):
            yield from settle()
            n = 0
    if waiting:
        yield from settle()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line with the number of its distinct shingles and their odd sketch."""
    with np.errstate(over="ignore"):
        for b in batches:
            for start in range(0, len(b), 2000):
                part = b.slice(start, 2000)
                hashes, owner = _shingle_hashes(part.column(1).to_pylist())
                # the line in the first bits and 52 of the hash in the others, so that one array is sorted
                keys = np.sort(owner.astype(np.uint64) << np.uint64(52) | hashes >> np.uint64(12))
                keys = keys[np.r_[True, keys[1:] != keys[:-1]][:len(keys)]]
                hashes, owner = keys & np.uint64(2**52 - 1), (keys >> np.uint64(52)).astype(np.int64)
                sketch = odd_sketch(hashes, owner, len(part), SKETCH_BITS)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(np.bincount(owner, minlength=len(part)).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * sketch.shape[1]), pa.array(sketch.ravel()))],
                    names=["id", "line", "size", "sketch"])


def _passing(bits: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows whose id (first column) the filter lets pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = bits_of([b.column(0).to_numpy()])
            yield b.filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
    return run


def _windows(line: str) -> np.ndarray | None:
    """The shingles of a line as sorted numbers, a byte for each character, if its characters are below 256."""
    try:
        keys = np.sort(np.ndarray(len(line), np.uint64, (line + PAD).encode("latin-1"), strides=(1,)))
        return np.concatenate([keys[:1], keys[1:][keys[1:] != keys[:-1]]])
    except UnicodeEncodeError:
        return None


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, own, exact = None, None, None
    for b in batches:
        linked = []
        for a, line_a, line_b in zip(b["a"], b["line_a"], b["line_b"]):
            if a != last:
                last, own, exact = a, _windows(line_a), None
            other = _windows(line_b)
            if own is not None and other is not None:
                every = np.sort(np.concatenate([own, other]))
                sizes, both = len(every), np.count_nonzero(every[1:] == every[:-1])
            else:
                exact, strings = exact or shingle_set(line_a), shingle_set(line_b)
                sizes, both = len(exact) + len(strings), len(exact & strings)
            linked.append(100 * both >= PERCENT * (sizes - both))
        yield b.loc[linked, ["a", "b"]]


def _confirm(pairs: DataFrame, texts: DataFrame, sketched: bool = False) -> DataFrame:
    """The pairs that are alike on their full sets; sizes and sketches spare most others the comparison, unless the pairs have passed them (``sketched``)."""
    pairs, texts = land(pairs, "pairs"), texts.select("id", "line") if sketched else texts
    both = pairs.alias("p").join(texts.alias("y"), F.expr("p.b = y.id")).join(texts.alias("x"), F.expr("p.a = x.id"))
    if not sketched:
        both = both.where(may_link("x", "y", "size", SKETCH_BITS, PERCENT))
    return both.select("p.a", "p.b", F.col("x.line").alias("line_a"), F.col("y.line").alias("line_b")).mapInPandas(_judge, "a bigint, b bigint")


def _exploded(docs: DataFrame, *columns) -> DataFrame:
    """A row for each line with a word: line_no (from 0), the line in lower case, its 64-bit id."""
    return (docs.select(*columns, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.regexp_like("line", F.lit(f"[^{SPACE}]")))
            .select(*columns, "line_no", F.lower("line").alias("line")).withColumn("id", F.xxhash64("line")))


def line_classes(docs: DataFrame, n_lines: int) -> DataFrame:
    """(id, component) for the ids of the lines that share a bucket with another one: the classes of the links between different
    lines whose character shingles are alike to 0.8 or more. ``n_lines`` sets the number of tasks."""
    lines = _exploded(docs).select("id", "line")
    tasks = -(-n_lines * (BINS // ROWS) // TASK_ROWS) or 1
    packed = lines.mapInArrow(_packed(8 * tasks), "part bigint, buckets binary, ids binary").repartition(tasks, "part")
    shared = land(packed.mapInArrow(_stars, "bucket bigint, id bigint, a bigint").distinct(), "buckets")
    firsts = shared.where("id != a").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    wanted = land(shared.select("id").distinct(), "wanted")
    # Lines in no shared bucket mostly stop at a filter of fixed size, before their texts are shuffled; the join drops the others.
    bits = docs.sparkSession.sparkContext.broadcast(phrase_filter(wanted))
    texts = (lines.mapInArrow(_passing(bits), "id bigint, line string").join(wanted, "id", "left_semi")
             .groupBy("id").agg(F.first("line").alias("line")))
    texts = land(texts.mapInArrow(_sketches, "id bigint, line string, size bigint, sketch array<bigint>"), "texts")
    bits.destroy()
    named = _joined(wanted.withColumn("component", F.col("id")), land(_confirm(firsts, texts), "links"))
    # The pairs with a centre are judged. A second star between the other members of buckets that still hold several
    # components, its centre drawn anew for each, then the pairs that are left.
    y = land(_open(shared.where("id != a").select("bucket", "id"), named).join(texts.select("id", "size", "sketch"), "id"), "open")
    centres = land(y.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", "bucket"), "id"))["id"].alias("id")), "centres")
    x = y.join(centres, ["bucket", "id"])
    named = _joined(named, land(_confirm(_apart(x, y, "x.component != y.component"), texts, sketched=True), "again"))
    y = land(_open(y.drop("component").join(centres, ["bucket", "id"], "left_anti"), named), "open")
    # A pair that shares several buckets leaves the join from the least of them alone.
    held = y.groupBy("id").agg(F.sort_array(F.collect_set("bucket")).alias("held"))
    y = land(y.join(held, "id"), "held")
    return _joined(named, land(_confirm(_apart(y, y, "x.component < y.component", once=True), texts, sketched=True), "more"))


def _joined(named: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) with the components that links (a, b) bring together; only components are walked, not their lines."""
    side = lambda end: named.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    lower = components(links.join(side("a"), "a").join(side("b"), "b"), "of_a", "of_b")
    lower = lower.select(F.col("node").alias("component"), F.col("component").alias("low"))
    return land(named.join(lower, "component", "left").select("id", F.coalesce("low", "component").alias("component")), "components")


def _open(members: DataFrame, named: DataFrame) -> DataFrame:
    """The members (bucket, id) of the buckets in which they belong to several components, with these."""
    named = members.join(named, "id")
    split = named.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("bucket")
    return named.join(split, "bucket")


def _apart(x: DataFrame, y: DataFrame, order: str, once: bool = False) -> DataFrame:
    """Pairs (a, b) of a bucket from different components that may be alike; ``once``: from the least bucket that both hold."""
    on = F.expr(f"x.bucket = y.bucket AND {order}") & may_link("x", "y", "size", SKETCH_BITS, PERCENT)
    if once:
        on = on & (F.array_min(F.array_intersect("x.held", "y.held")) == F.col("x.bucket"))
    return x.alias("x").join(y.alias("y"), on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with n_lines, removed (line numbers from 0) and the text without these lines.

    Lines are compared in lower case by the sets of their 8-character shingles: one-permutation signatures of 64 bins in 16
    bands of 4 find a pair at 0.8 with probability 0.9998; each bucket gives a star of edges from one of its lines, one from
    a drawn line if it then still holds several components, and pairs between those that it holds after both, but for those whose sizes and odd sketches of 1024 bits show
    that they differ in too many shingles; all are verified on the full sets. Of each component of
    lines over all documents, exact copies included, the one with the smallest (doc_id, line number) stays.

    Lines without a word stay and are compared with nothing. Nulls: a null text stays null, with no lines; a null doc_id comes
    first. Rows with the same doc_id and text are one place: they keep the same lines. A document may lose all its lines; its
    text is then empty. An empty table gives no rows. Columns named n_lines and removed are replaced.
    """
    base = docs.drop("n_lines", "removed").withColumn("llm_row_key", F.xxhash64("doc_id", "text"))
    found = land(_exploded(base, "doc_id", "llm_row_key").select("doc_id", "llm_row_key", "line_no", "id"), "lines")
    place = F.struct("doc_id", "llm_row_key", "line_no")
    of = line_classes(base.select("text"), found.count())
    # A line that occurs once and shares no bucket is alone in its component.
    named = (found.groupBy("id").agg(F.count("*").alias("n")).join(of, "id", "left").where("n > 1 OR component IS NOT NULL")
             .withColumn("component", F.coalesce("component", "id")))
    many = named.groupBy("component").agg(F.sum("n").alias("lines")).where("lines > 1").select("component")
    repeated = land(found.join(named.join(many, "component").select("id", "component"), "id"), "repeated")
    keepers = repeated.groupBy("component").agg(F.min(place).alias("keeper"))
    removed = (repeated.join(keepers, "component").where(~place.eqNullSafe(F.col("keeper")))
               .groupBy(F.col("doc_id").alias("llm_gone_id"), F.col("llm_row_key").alias("llm_gone_key")).agg(F.sort_array(F.collect_set("line_no")).alias("removed")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    out = base.withColumn("n_lines", n_lines.cast("bigint")).join(removed, F.expr("doc_id <=> llm_gone_id AND llm_row_key = llm_gone_key"), "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(
        F.concat_ws("\n", F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("removed", i))))
    return out.withColumns({"text": text, "removed": gone}).select(*[c for c in docs.columns if c not in ("n_lines", "removed")], "n_lines", "removed")
