"""One-permutation MinHash signatures, banded buckets and odd sketches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signatures(hashes: np.ndarray, owners: np.ndarray, n: int, bins: int) -> np.ndarray:
    """(n, bins): the least hash of each owner in each bin. An empty bin takes the value of a full one, picked by a
    sequence of hashes of the bin and the attempt that all sets share. Owners without hashes stay empty."""
    out = np.full(n * bins, EMPTY, np.uint64)
    place = owners.astype(np.int64) * bins + ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out, place, mix(hashes))
    out = out.reshape(n, bins)
    full = out != EMPTY
    row, column = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    source = out.copy()
    while len(row):
        attempt += 1
        pick = (mix(column.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt * 7919)) % np.uint64(bins)).astype(np.int64)
        hit = full[row, pick]
        out[row[hit], column[hit]] = source[row[hit], pick[hit]]
        row, column = row[~hit], column[~hit]
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """(n, bins / rows): a key for each band of ``rows`` bins, different for each band."""
    n, bins = signature.shape
    parts = signature.reshape(n, bins // rows, rows)
    key = np.arange(bins // rows, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    for i in range(rows):
        key = mix(key * np.uint64(0x100000001B3) ^ parts[:, :, i])
    return key.view(np.int64)


def odd_sketch(hashes: np.ndarray, owners: np.ndarray, n: int, bits: int) -> np.ndarray:
    """(n, bits / 64) longs: each bit says whether an odd number of the owner's distinct hashes falls on it.

    The exclusive or of two sketches is that of what only one of the sets has, so it has at most as many bits set.
    """
    odd = np.bincount(owners.astype(np.int64) * bits + (mix(hashes) % np.uint64(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def may_link(x: str, y: str, size: str, bits: int, percent: int) -> Column:
    """False only for pairs that cannot be alike enough, by the sizes and sketches of ``x`` and ``y``.

    Sets of s elements in all, d of them in one set only, have a likeness of (s - d) / (s + d).
    """
    differ = sum((F.bit_count(F.get(f"{x}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(i)))) for i in range(1, bits // 64)),
                 F.bit_count(F.get(f"{x}.sketch", F.lit(0)).bitwiseXOR(F.get(f"{y}.sketch", F.lit(0)))))
    least = F.greatest(differ.cast("bigint"), F.abs(F.col(f"{x}.{size}") - F.col(f"{y}.{size}")))
    return (100 + percent) * least <= (100 - percent) * (F.col(f"{x}.{size}") + F.col(f"{y}.{size}"))
