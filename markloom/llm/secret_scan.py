"""Secret scans with an incremental blob ledger (operator 9)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import land


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules. A run of enough characters is the leftmost whole run, so `least` stands in the pattern.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
#: Kinds beyond the base: private keys and signed web tokens.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
LEDGER = "blob string, rule string, spans array<struct<start:bigint,end:bigint>>"


def spans(text: Column, rule: Rule) -> Column:
    """Code-point spans of a rule's matches: lengths of the parts between matches and of the matches, added up."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    rows = F.arrays_zip(found.alias("found"), checked.alias("checked"), gaps.alias("gap"))
    kind = "struct<at:bigint,out:array<struct<start:bigint,end:bigint>>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out")).cast(kind)

    def add(acc: Column, row: Column) -> Column:
        begin = acc["at"] + row["gap"]
        end = begin + F.char_length(row["found"])
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        keep = F.char_length(row["checked"]) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out")).cast(kind)

    whole = F.aggregate(F.filter(rows, lambda r: r["found"].isNotNull()), start, add)["out"]
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), whole).otherwise(start["out"])


def scan(versions: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, new ledger rows) for a table of versions: ``path`` and ``text``.

    A version's blob is the SHA-256 of its text. One version of each blob is scanned, and only by rules that the
    ``ledger`` (blob, rule, spans) does not have for it; the new rows have an entry for each rule, spans or none. ``paths`` has
    every version's path and blob with the spans of all rules: map of rule to spans, from old and new rows.
    Null texts are empty; null and repeated paths keep a row each; an empty table gives no rows.
    """
    named = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    keys = F.array(*[F.lit(r.key) for r in rules])
    todo = named.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        seen = ledger.where(F.col("rule").isin(*[r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("todo") > 0)
    else:
        todo = todo.withColumn("todo", keys)
    entry = [F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.key).alias("rule"), spans(F.col("text"), r).alias("spans"))) for r in rules]
    fresh = land(todo.select("blob", F.inline(F.filter(F.array(*entry), lambda e: e.isNotNull()))), "ledger")
    known = fresh if ledger is None else fresh.unionByName(ledger.where(F.col("rule").isin(*[r.key for r in rules])).select("blob", "rule", "spans"))
    found = (known.where(F.size("spans") > 0).groupBy("blob")
             .agg(F.map_from_entries(F.collect_list(F.struct("rule", "spans"))).alias("found")))
    empty = F.create_map().cast("map<string,array<struct<start:bigint,end:bigint>>>")
    paths = named.select("path", "blob").join(found, "blob", "left").select("path", "blob", F.coalesce("found", empty).alias("found"))
    return paths, fresh


def listed(rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the spans in ``found`` under ``rules``, by start, then in the order of the rules."""
    def rows(place: int, rule: Rule) -> Column:
        own = F.coalesce(F.try_element_at("found", F.lit(rule.key)), F.array().cast("array<struct<start:bigint,end:bigint>>"))
        return F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), F.concat_ws(":", F.lit(rule.kind), s["start"], s["end"]).alias("text")))

    each = [rows(i, r) for i, r in enumerate(rules)]
    return F.concat_ws(",", F.sort_array(F.concat(*each))["text"])


def count(rule: Rule) -> Column:
    return F.coalesce(F.size(F.try_element_at("found", F.lit(rule.key))), F.lit(0)).cast("bigint")
