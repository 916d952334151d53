"""Quality rules with cross-document line frequency (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import SPACE, land, let, words

#: A line is boilerplate of a host if more than so many of its distinct documents have it, however large the host is.
MOST_DOCS = 10
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.5
LEAST_WORDS = 50


def n_repeat_words(w: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    Windows are hashed and sorted with their place; a window next to an equal one repeats. The places of these, in
    order, cover three words each less what they share with the one before.
    """
    def windows(h: Column) -> Column:
        pairs = F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.xxhash64(a, b))
        return F.filter(F.zip_with(pairs, F.slice(h, F.lit(3), F.size(h)), lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab, c))), lambda x: x.isNotNull())

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), _covered)).cast("bigint")


def _covered(windows: Column) -> Column:
    def places(pairs: Column) -> Column:
        same = F.filter(pairs, lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | (F.get(pairs, i + 1)["h"] == p["h"]))
        return F.sort_array(same["i"])

    def total(at: Column) -> Column:
        return F.aggregate(F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, lambda p: let(places(p), total)))


def normalised(line: Column) -> Column:
    """A line in lower case, digits as 0, white space as one blank."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "0"), f"[{SPACE}]+", " "))


def _lines(text: Column) -> Column:
    """The lines of a text that have a word: hash of the normal form, and number of words."""
    with_word = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]")))
    return F.transform(with_word, lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), F.regexp_count(x, F.lit(f"[^{SPACE}]+")).alias("words")))


def frequent_lines(lines: DataFrame, most: int) -> DataFrame:
    """(source, line): hashes of the lines that more than ``most`` documents of their host have. Documents with the same text count once, as
    copies are for the near-duplicate stages to judge."""
    once = lines.groupBy("source", "same").agg(F.first("lines.line").alias("lines"))
    seen = once.select("source", F.explode(F.array_distinct("lines")).alias("line")).groupBy("source", "line").agg(F.count("*").alias("n"))
    return seen.where(F.col("n") > most).select("source", "line")


def judge(docs: DataFrame, most: int = MOST_DOCS) -> DataFrame:
    """The columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words_left,
    removed (hashes of the lines to go) and kept.

    Base rules: at least 50 words, and not more than half of them in repeated windows of three. Method: lines that more
    than 10 distinct documents of the host (``source``) have are removed, by this one limit at every size of host; a document
    with under half of its words left is rejected. Nulls: a null text has no words and fails; null sources are one host; null and repeated doc_ids keep
    a row each. Lines without a word are never counted or removed. An empty table gives no rows. Columns of ``docs`` with
    the names of results are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_left", "removed", "kept"]
    base = docs.drop(*made)
    key = F.xxhash64("doc_id", "source", "text")
    lines = land(base.select("source", key.alias("llm_row_key"), F.xxhash64("text").alias("same"), _lines(F.coalesce("text", F.lit(""))).alias("lines")), "lines")
    frequent = frequent_lines(lines, most)
    hits = (lines.select("source", "llm_row_key", F.explode(F.array_distinct("lines.line")).alias("line"))
            .join(frequent.select(F.col("source").alias("s"), F.col("line").alias("l")), F.expr("source <=> s AND line = l"))
            .groupBy("llm_row_key").agg(F.collect_set("line").alias("removed")))
    left = F.aggregate(F.filter("lines", lambda x: ~F.array_contains("removed", x["line"])), F.lit(0), lambda s, x: s + x["words"])
    verdict = (lines.groupBy("llm_row_key").agg(F.first("lines").alias("lines")).join(hits, "llm_row_key")
               .select(F.col("llm_row_key").alias("llm_key"), F.col("removed").alias("llm_removed"), left.cast("bigint").alias("llm_left")))
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("bigint")
    full = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]")))
    facts = base.select(
        "*", key.alias("llm_row_key"), n.alias("n_words"),
        (F.char_length(text) - F.regexp_count(text, F.lit(f"[{SPACE}]"))).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        n_repeat_words(words(F.col("text"))).alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = facts.join(verdict, F.col("llm_row_key") == F.col("llm_key"), "left").withColumns({
        "base_failed": failed, "n_words_left": F.coalesce("llm_left", "n_words"),
        "removed": F.coalesce("llm_removed", F.array().cast("array<bigint>"))})
    kept = ~F.col("base_failed") & (F.col("n_words_left") >= LEAST_LEFT * F.col("n_words"))
    return out.withColumn("kept", kept).select(*base.columns, *made)


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their boilerplate lines, with the columns of ``docs``. n_chars is counted anew."""
    judged = judge(docs).where("kept")
    stay = F.filter(F.split("text", "\n"), lambda x: ~(F.regexp_like(x, F.lit(f"[^{SPACE}]")) & F.array_contains("removed", F.xxhash64(normalised(x)))))
    out = judged.withColumn("text", F.when(F.size("removed") > 0, F.concat_ws("\n", stay)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
