"""Answers and scores kept as maps, and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# checklists common to all forms; they are no items (fixed values)
COMMON_CHECKLISTS = ["PEC", "ICC", "RKC", "CC"]


def parse_map(text: Column, value_type: str = "string") -> Column:
    """JSON text (single quotes allowed) to a map; broken text gives an empty map.

    Text that is no JSON is read once more as a literal, with None, True and False.
    """
    kind = f"map<string,{value_type}>"
    literal = text
    for word, json in (("None", "null"), ("True", "true"), ("False", "false")):
        # a quoted string is matched whole and put back as it is; a bare word between delimiters is replaced
        literal = F.regexp_replace(literal, rf"""("(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')|(?<=[:,\[\s]){word}(?=\s*[,}}\]])""", f"$1\u0001{json}")
        literal = F.regexp_replace(F.regexp_replace(literal, rf"(?<=[\"'])\u0001{json}", ""), "\u0001", "")
    return F.coalesce(F.from_json(text, kind), F.from_json(literal, kind), F.create_map().cast(kind))


def without(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def items_of(m: Column, excluded: list[str] | None = None) -> Column:
    """Item codes in keys ``role_item_MCn``, sorted, each once."""
    excluded = COMMON_CHECKLISTS if excluded is None else excluded
    names = F.transform(F.map_keys(m), lambda k: F.get(F.split(k, "_"), F.lit(1)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & ~n.isin(*excluded))))


def answers_of(m: Column, item: str) -> Column:
    """The part of the map that belongs to one item."""
    return F.map_filter(m, lambda k, v: F.get(F.split(k, "_"), F.lit(1)) == item)


def first_score(scores: Column, key: str, fallbacks: list[str]) -> Column:
    return F.coalesce(*[F.try_element_at(scores, F.lit(k)) for k in [key, *fallbacks]])
