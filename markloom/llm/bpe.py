"""Byte-level BPE encoding and decoding (operator 1)."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import let

#: A piece is one long: rank of the pair that begins with it, its byte offset, its id.
ID_BITS, OFFSET_BITS = 18, 27
RANK_SHIFT = ID_BITS + OFFSET_BITS
ID_MASK = 2**ID_BITS - 1
#: Above every rank: the pair does not merge.
NONE = ID_MASK
#: Characters of texts after which a task gives its new words on, and words that it remembers.
TEXT_CHARS, REMEMBERED = 1_000_000, 600_000
#: Longer words are not folded.
FOLD_BYTES = 256


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(maxsize=4)
def pair_table(path: str) -> tuple[list[int], list[int], list[int]]:
    """(base, owner, rank): the pair of ids (l, r) merges to rank[base[l] + r] if owner[base[l] + r] is l, else to nothing.

    The rows of all left ids share one array, each shifted to a place where its entries meet no others.
    """
    ranks = read_ranks(path)
    rows: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                rows.setdefault(left, {})[right] = rank
    top = max(ranks.values()) + 1
    room = 1 << (sum(map(len, rows.values())) + top).bit_length()
    owner, merged, base = np.full(room + top, -1, np.int64), np.zeros(room + top, np.int64), [0] * top
    draw = np.random.default_rng(1)
    for left, row in sorted(rows.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        rights = np.fromiter(row, np.int64, len(row))
        free = np.empty(0, np.int64)
        while not len(free):
            at = draw.integers(0, room, max(8, 20_000 // len(row)))
            free = at[(owner[at[:, None] + rights] < 0).all(1)]
        owner[free[0] + rights], merged[free[0] + rights], base[left] = left, list(row.values()), int(free[0])
    used = int(np.flatnonzero(owner >= 0)[-1]) + 1
    return base, owner[:used].tolist(), merged[:used].tolist()


def _array(values: list[int]) -> Column:
    """A constant array; the optimiser folds it to a literal."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<int>")


def merge_bytes(pieces: Column, path: str) -> Column:
    """Fold ranked merges over an array of pieces: each step joins the leftmost pair of the lowest rank."""
    base, owner, rank = map(_array, pair_table(path))
    done = F.array_min(pieces) >= NONE << RANK_SHIFT
    # A plan spells out each mention of a constant, and the driver keeps the text for each execution; as variables they are named once.
    folded = let(base, lambda b: let(owner, lambda o: let(rank, lambda r: _fold(pieces, b, o, r))))
    return F.when(pieces.isNull() | done, pieces).otherwise(folded)


def _fold(pieces: Column, base: Column, owner: Column, rank: Column) -> Column:
    def id_of(piece: Column) -> Column:
        return piece.bitwiseAND(F.lit(ID_MASK)).cast("int")

    def piece(e: Column, left: Column, right: Column) -> Column:
        """``e`` with the id ``left`` and the rank of its pair with ``right``."""
        slot = F.get(base, left) + right
        found = F.when(F.get(owner, slot) == left, F.get(rank, slot)).otherwise(F.lit(NONE))
        kept = e.bitwiseAND(F.lit((2**OFFSET_BITS - 1) << ID_BITS))
        return F.shiftleft(found.cast("bigint"), RANK_SHIFT).bitwiseOR(kept).bitwiseOR(left.cast("bigint"))

    def join_low(p: Column, low: Column) -> Column:
        merged = F.shiftright(low, RANK_SHIFT).cast("int")
        return F.array_remove(F.transform(p, lambda e, i: F.when(e == low, piece(e, merged, id_of(F.get(p, i + 2))))
                                    .when(F.get(p, i + 1) == low, piece(e, id_of(e), merged))
                                    .when(F.get(p, i - 1) == low, F.lit(-1).cast("bigint"))
                                    .otherwise(e)), F.lit(-1).cast("bigint"))

    def step(p: Column, _: Column) -> Column:
        low = F.array_min(p)
        return F.when(low >= NONE << RANK_SHIFT, p).otherwise(F.aggregate(F.array(low), p, join_low))

    return F.aggregate(F.sequence(F.lit(2), F.size(pieces)), pieces, step)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long word: pairs are joined in the order of (rank, place) by a heap over a linked list."""
    n = len(word)
    end, back, on = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))  # end, piece before and piece after of each piece
    pair = [ranks.get(word[i:i + 2], -1) for i in range(n - 1)] + [-1]
    heap = [rank << 40 | i for i, rank in enumerate(pair) if rank >= 0]
    heapq.heapify(heap)
    while heap:
        rank, i = divmod(heapq.heappop(heap), 1 << 40)
        if pair[i] != rank:  # an entry from before a merge
            continue
        gone = on[i]
        end[i], on[i], pair[gone] = end[gone], on[gone], -1
        if on[i] < n:
            back[on[i]] = i
        for at in (back[i], i):
            if at >= 0:
                pair[at] = ranks.get(word[at:end[on[at]]], -1) if on[at] < n else -1
                if pair[at] >= 0:
                    heapq.heappush(heap, pair[at] << 40 | at)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = on[i]
    return out


#: A row is a word, numbered by its place since the last row of nulls, or a text (codes: the numbers of its words).
SPLIT = "word array<bigint>, doc_id bigint, codes binary"


class _Parts(dict):
    """What follows a space up to the next one, to the numbers of its words; a space before other than white space begins a word."""

    def __init__(self, find):
        self.find, self.seen = find, {}

    def codes(self, found: list[str]) -> tuple[int, ...]:
        return tuple(self.seen.setdefault(w, len(self.seen)) for w in found)

    def __missing__(self, part: str) -> tuple[int, ...]:
        self[part] = out = self.codes(self.find(" " + part))
        return out


def _splitter(path: str, pattern: str, limit: int, remembered: int):
    def words(raw: list[bytes], ranks: dict[bytes, int], pairs: np.ndarray, singles: np.ndarray) -> pa.RecordBatch:
        offsets = np.cumsum([0, *map(len, raw)], dtype=np.int64)
        flat = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        rank = pairs[flat[:-1].astype(np.int64) << 8 | flat[1:]]
        rank[offsets[1:] - 1] = NONE
        place = np.arange(len(flat) - 1) - np.repeat(offsets[:-1], np.diff(offsets))
        values, at = [rank << RANK_SHIFT | place << ID_BITS | singles[flat[:-1]]], 0
        # A word that is a token stands for itself, as in the library; a long word is merged here. Nothing is left to fold of these.
        ready = [i for i, w in enumerate(raw) if w in ranks or len(w) > FOLD_BYTES]
        if ready:
            every, values = values[0], []
            for i in ready:
                ids = [ranks[raw[i]]] if raw[i] in ranks else merge_long(raw[i], ranks)
                values += [every[at:offsets[i]], NONE << RANK_SHIFT | np.array(ids, np.int64)]
                at = offsets[i + 1]
            values.append(every[at:])
            sizes = np.diff(offsets)
            sizes[ready] = [len(v) for v in values[1::2]]
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values)))
        return batch(lists, pa.nulls(len(raw), pa.int64()), pa.nulls(len(raw), pa.binary()))

    def batch(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*columns], names=["word", "doc_id", "codes"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        find, run, ranks = regex.compile(pattern).findall, regex.compile(r" (?:\s|$)").search, read_ranks(path)
        singles = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
        pairs = np.array([ranks.get(bytes([x, y]), NONE) for x in range(256) for y in range(256)], np.int64)
        lists = pa.list_(pa.int64())
        parts, given, ids, codes, chars = _Parts(find), 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            new = [w.encode() for w in islice(parts.seen, given, None)]
            for start in range(0, len(new), 10_000):
                yield words(new[start:start + 10_000], ranks, pairs, singles)
            yield batch(pa.nulls(len(ids), lists), pa.array(ids, pa.int64()), pa.array(codes, pa.binary()))

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if not text or run(text):
                    own = parts.codes(find(text or ""))
                else:
                    first, *rest = text.split(" ")
                    own = [*parts.codes(find(first)), *chain.from_iterable(map(parts.__getitem__, rest))]
                codes.append(np.array(own, np.int32).tobytes())
                ids.append(i)
                chars += len(text or "")
                if chars >= limit or len(parts) >= remembered:
                    yield from flush()
                    given, ids, codes, chars = len(parts.seen), [], [], 0
                    if max(len(parts), given) >= remembered:
                        yield batch(pa.nulls(1, lists), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()))
                        parts, given = _Parts(find), 0
        if ids:
            yield from flush()

    return split


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each pair, end to end."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)
    return values[at]


ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _assembler(path: str, extra: list[str]):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker left
        ranks = read_ranks(path)
        vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            vocabulary[rank] = token
        sizes = np.array([*map(len, vocabulary)], np.int64)
        places, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(vocabulary), np.uint8)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *extra]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * len(extra)]
        none = np.empty(0, np.int64)
        values, lengths = [none], [none]  # the ids of the words since the last row of nulls
        for b in batches:
            kind = np.where(b.column(0).is_valid(), 0, np.where(b.column(2).is_valid(), 1, 2))
            edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), b.num_rows]
            for start, stop in zip(edges, edges[1:]):
                run = b.slice(start, stop - start)
                if not run.num_rows:
                    continue
                if kind[start] == 0:
                    values.append(run.column(0).flatten().to_numpy() & ID_MASK)
                    lengths.append(pc.list_value_length(run.column(0)).to_numpy().astype(np.int64))
                elif kind[start] == 2:
                    values, lengths = [none], [none]
                else:
                    values, lengths = [np.concatenate(values)], [np.concatenate(lengths)]
                    starts, out = np.cumsum(lengths[0]) - lengths[0], []
                    for i, codes in zip(run.column(1).to_pylist(), run.column(2)):
                        own = np.frombuffer(codes.as_buffer(), np.int32)
                        tokens = _gather(values[0], starts[own], lengths[0][own])
                        packed = tokens.astype("<u4").tobytes()
                        decoded = _gather(flat, places[tokens], sizes[tokens]).tobytes()
                        digest = (i, len(tokens), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest())
                        out.append((*digest, *({"ids": packed, "decoded": decoded}[x] for x in extra)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return assemble


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, text_chars: int = TEXT_CHARS, remembered: int = REMEMBERED,
           with_decoded: bool | None = None) -> DataFrame:
    """Ids of every text by the merge ranks in ``path``, and the text decoded from them.

    Each match of ``pattern`` is merged by itself. Tasks cut texts into words and number the distinct words; Spark folds the
    merges over the byte arrays of these, a row a word; tasks then put the ids of each text together, and the
    decoded text from the byte pieces of the ids. A task gives its new words on after some ``text_chars`` characters of
    texts and forgets them beyond ``remembered`` words, so rows and memory stay small. A word of more than 256 bytes is merged in the
    task by a heap, in n log n steps, as a fold would take the square of its length. Nothing is shuffled.

    Returns doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids) and decoded_sha256; ``with_ids`` adds the
    ids (packed), ``with_decoded`` the decoded bytes (left open: as ``with_ids``). Null and empty texts have no ids; repeated rows and null ids give a row
    each; other columns are ignored; an empty table gives no rows. One text is held whole in a task.
    """
    if max(read_ranks(path).values()) >= NONE:
        raise ValueError("too many ranks")
    cut = docs.select("doc_id", "text").mapInArrow(_splitter(path, pattern, text_chars, remembered), SPLIT)
    merged = cut.select(merge_bytes(F.col("word"), path).alias("word"), "doc_id", "codes")
    extra = ["ids"] * with_ids + ["decoded"] * (with_ids if with_decoded is None else with_decoded)
    return merged.mapInArrow(_assembler(path, extra), ", ".join([ENCODED, *(f"{x} binary" for x in extra)]))


def decode(ids: Column, vocabulary: Column) -> Column:
    """The bytes of an array of ids: their pieces in an array of binaries, end to end."""
    return F.aggregate(ids, F.lit(b"").cast("binary"), lambda out, i: F.concat(out, F.get(vocabulary, i)))
