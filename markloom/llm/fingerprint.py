"""Homomorphic document fingerprints (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from markloom.llm.common import land

#: 32-bit words of the exact part, each summed modulo 2**32.
EXACT = 16
#: Counters of the part for likeness; two share a long.
COUNTERS = 64
LOW = 0xFFFFFFFF
LEAST = -(2**63)


#: Where a phrase ends: at blanks after a mark or after one of a few letters. Some three words a phrase.
PHRASE_END = r"(?<=[.!?;,:aeo])[\x20\t]+"


def elements(text: Column) -> Column:
    """A text's multiset: its paragraphs (lines), and the distinct phrases of each paragraph."""
    lines = F.split(text, "\n")
    phrases = F.flatten(F.transform(lines, lambda x: F.array_distinct(F.split(x, PHRASE_END))))
    return F.array(F.struct(F.lit(0).alias("kind"), lines.alias("pieces")), F.struct(F.lit(1).alias("kind"), phrases.alias("pieces")))


def sums(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per key, the sum of the vectors of all elements of its texts: e0.. (exact), c0.. (likeness), n (phrases).

    A paragraph adds a vector of 16 words hashed from it; a phrase adds +1 or -1 to each of 64 counters. Sums are
    the same in any order; those of two texts add up to those of both, and an edit subtracts what goes and adds what comes.
    """
    pieces = (texts.select(*keys, F.explode(elements(F.col(text))).alias("e")).select(*keys, "e.kind", F.explode("e.pieces").alias("piece"))
              .select(*keys, "kind", F.xxhash64("piece").alias("h"), F.xxhash64(F.lit("second"), "piece").alias("g")))
    paragraph, phrase = F.col("kind") == 0, F.col("kind") == 1
    exact = [F.sum(F.when(paragraph, F.shiftrightunsigned(F.xxhash64(F.lit(i), "h", "g"), 32)).otherwise(0)).alias(f"e{i}") for i in range(EXACT)]
    pair = F.lit(1 << 32 | 1)
    signs = [F.sum(F.when(phrase, F.shiftrightunsigned("h", j).bitwiseAND(pair)).otherwise(0)).alias(f"c{j}") for j in range(COUNTERS // 2)]
    return pieces.groupBy(*keys).agg(*exact, *signs, F.sum("kind").cast("bigint").alias("n"))


def fingerprint(side: str = "") -> Column:
    """The vector in hexadecimal: 16 words modulo 2**32, then the counters modulo 2**16."""
    words = [F.lpad(F.lower(F.hex(F.col(f"{side}e{i}").bitwiseAND(F.lit(LOW)))), 8, "0") for i in range(EXACT)]
    counters = [F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFF)))), 4, "0") for x in _counters(side)]
    return F.concat(*words, *counters)


def _counters(side: str) -> list[Column]:
    """Elements with the bit set, for each of the 64 bits of the hash."""
    return [x for j in range(COUNTERS // 2) for x in
            (F.col(f"{side}c{j}").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(F.col(f"{side}c{j}"), 32))]


def likeness(left: str, right: str) -> Column:
    """1 for equal sums; else the estimated share of phrases that both sides have, between 0 and 1.

    A counter's signed value is twice its bits less the number of elements. Of two texts, the mean product of the counters
    estimates what they share, the mean squares what each has; the result is twice the first over the sum of the others.
    """
    n, m = F.col(f"{left}n").cast("double"), F.col(f"{right}n").cast("double")
    pairs = [(2.0 * a - n, 2.0 * b - m) for a, b in zip(_counters(left), _counters(right))]
    total = lambda xs: F.aggregate(F.array(*xs), F.lit(0.0), lambda s, x: s + x)
    shared, own = total([a * b for a, b in pairs]), total([a * a + b * b for a, b in pairs])
    words = lambda side: F.array(*[F.col(f"{side}e{i}").bitwiseAND(F.lit(LOW)) for i in range(EXACT)])
    share = F.when(own == 0, 0.0).otherwise(2.0 * shared / own)
    return F.when(words(left) == words(right), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def next_keys(ids: DataFrame, key: str) -> DataFrame:
    """(key, next_key) for each distinct key, the last one leading to the first. Keys are dealt out by range and
    numbered within their range; only a row for each range is ordered as a whole."""
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.select(key).distinct().repartitionByRange(parts, key).withColumn("part", F.spark_partition_id())
    edges = dealt.groupBy("part").agg(F.min(key).alias("first"))
    over = W.orderBy("first")  # one row for each range
    ends = edges.select("part", F.lead("first").over(over).alias("after"), F.min("first").over(W.partitionBy()).alias("start"))
    return (dealt.withColumn("own_next", F.lead(key).over(W.partitionBy("part").orderBy(key))).join(ends, "part")
            .select(key, F.coalesce("own_next", "after", "start").alias("next_key")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they and the next document's are.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document's.
    Fingerprints are homomorphic multiset hashes, see ``sums``: texts with the same paragraphs in another order
    have the same one. Nulls: a null text is empty; a null doc_id comes first in the order (as -2**63, which stands for it). Rows that share a doc_id
    are one place in the order: as next document, the least of their beginnings is used; each keeps its row. A single
    document is its own next. An empty table gives no rows. Other columns are ignored. Sums hold up to 2**31 pieces a text.
    """
    base = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = base.groupBy("key").agg(F.max(F.char_length("text")).alias("longest"))
    sizes = land(sizes, "sizes")
    asked = next_keys(sizes, "key").join(sizes, "key").select(
        F.col("next_key").alias("key"), F.col("key").alias("asker"), F.floor(F.col("longest") / 2).cast("int").alias("need"))
    heads = (base.join(asked, "key").groupBy(F.col("asker").alias("key"), F.col("key").alias("next_key"))
             .agg(F.min(F.substring("text", F.lit(1), F.col("need"))).alias("head")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    row = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("text")))
    both = (base.join(heads, "key").withColumn("half", half)
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.char_length("text") - F.col("half")), F.substring("head", F.lit(1), F.col("half"))))
            .select("key", "next_key", "text", "edited", row.alias("row")))
    sides = both.select("key", "next_key", "row", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))))
    facts = sides.select("key", "next_key", "row", "side", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("sha"), "text")
    vectors = land(sums(facts, ["key", "next_key", "row", "side", "n_chars", "sha"], "text"), "vectors")

    def of(side: int, name: str, *keep: str) -> DataFrame:
        kept = [c for c in vectors.columns if c[0] in "ecn" and c not in ("n_chars", "next_key")]
        return vectors.where(F.col("side") == side).select(*keep, *[F.col(c).alias(f"{name}_{c}") for c in kept])

    own = of(0, "o", "key", "next_key", "row", "n_chars")
    edited = of(1, "x", "key", "row", F.col("sha"))
    after = of(0, "z", F.col("key").alias("next_key"), F.col("row").alias("z_row")).where("z_row = 1")
    return (own.join(edited, ["key", "row"]).join(after, "next_key").select(
        F.nullif("key", F.lit(LEAST)).alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"),
        fingerprint("o_").alias("fingerprint"), fingerprint("x_").alias("edited_fingerprint"),
        likeness("o_", "x_").alias("near_edited"), likeness("o_", "z_").alias("near_next")))
