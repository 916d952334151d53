"""Question headers as columns of a header table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.operators.ordering import beside_text, ordered_distinct, row_numbers

# header positions numbered by one task
HEADER_PIECE = 1_000


def _replaced(value: Column, mapping: dict[str, str]) -> Column:
    """The mapped value, else the value itself."""
    out = value
    for old, new in mapping.items():
        out = F.when(value == old, new).otherwise(out)
    return out


def parse_headers(df: DataFrame, header: str) -> DataFrame:
    """Add code, tag, role, label and name to a table of headers ``CODE TAG#role_q``.

    Headers that are no question are left out. A last part ``TEXT`` is the tooth number
    of the checklist.
    """
    h = F.col(header)
    part = lambda pattern: F.regexp_extract(h, pattern, 1)
    checklist = F.lit(None).cast("string")
    for title, short in K.CHECKLIST_HEADERS.items():
        checklist = F.when(h.startswith(f"{title}#"), short).otherwise(checklist)
    pieces = df.filter(h.rlike("#[^_]*_")).withColumns({
        "_checklist": checklist, "_code": part(r"^([^\s#]*)"),
        "_tag": F.upper(F.regexp_replace(part(r"^\S+\s+([^#]*)#"), r"\s+", " ")),
        "_role": part("#([^_]*)_"), "_q": part("#[^_]*_([^_]*)"),
    })
    parsed = pieces.withColumns({
        "code": F.coalesce("_checklist", "_code"),
        "tag": F.when(F.col("_checklist").isNull() & (F.col("_tag") != ""), _replaced(F.col("_tag"), K.TAG_CORRECTIONS)),
        "role": _replaced(F.col("_role"), K.ROLE_NUMBERS),
        "label": F.when(h.endswith("_TEXT"), "Tooth Number").otherwise(F.concat(F.lit("MC"), "_q")),
    }).drop("_checklist", "_code", "_tag", "_role", "_q")
    suffix = F.coalesce(F.concat(F.lit(" ("), "tag", F.lit(")")), F.lit(""))
    return parsed.withColumn("name", F.concat(F.concat_ws("_", "code", "label", "role"), suffix))


def _role_in(header: Column) -> Column:
    return F.when(header.contains("Student"), "student").otherwise("supervisor")


def number_headers(df: DataFrame, header: str, position: str) -> DataFrame:
    """Older spelling: questions are numbered by position inside (code, tag, role).

    ``df`` is a header table, a row per column of an export. Other headers keep their name.
    """
    h = F.col(header)
    first = F.get(F.split(h, r"\s+"), F.lit(0))
    second = F.get(F.split(h, r"\s+"), F.lit(1))
    setting = F.when(second.isin("SIM", "CLINIC"), second)
    role = _role_in(h)
    kind = (
        F.when(first.rlike(r"^\d+$") & second.isNotNull(), "code")
        .when(h.contains("Anesthesia") & second.isNotNull(), "anaesthesia")
        .when(h.contains("Sharpening") & second.isNotNull(), "sharpening")
    )
    base = (
        F.when(kind == "code", first)
        .when(kind == "anaesthesia", "LA")
        .when(kind == "sharpening", "Sharpening")
    )
    found = F.regexp_extract(F.get(F.split(h, r"\s-\s"), F.lit(0)), r"\((.*?)\)", 1)
    tag = (
        F.when(kind == "anaesthesia", F.coalesce(F.nullif(found, F.lit("")), F.lit("Unknown")))
        .otherwise(setting)
    )
    out = row_numbers(df.withColumns({"_base": base, "_tag": tag, "_role": role}), ["_base", "_tag", "_role"],
                      [position], F.floor(F.col(position) / HEADER_PIECE), "_n")
    name = F.when(F.col("_base").isNull(), h).otherwise(
        F.concat(F.col("_base"), F.lit("_MC"), F.col("_n"), F.lit("_"), F.col("_role"),
                 F.coalesce(F.concat(F.lit(" ("), F.col("_tag"), F.lit(")")), F.lit("")))
    )
    return out.withColumn("new_name", name).drop("_base", "_tag", "_role", "_n")


def number_other_headers(df: DataFrame, header: str, position: str) -> DataFrame:
    """Checklists common to all forms, numbered by position per role; rubric scales shortened."""
    h = F.col(header)
    short = F.lit(None).cast("string")
    for title, abbreviation in reversed(list(K.CHECKLIST_TITLES.items())):
        short = F.when(h.contains(title), abbreviation).otherwise(short)
    scale = F.lit(None).cast("string")
    for title, abbreviation in reversed(list(K.RUBRIC_SCALE_NAMES.items())):
        scale = F.when(h.contains(title), abbreviation).otherwise(scale)
    out = row_numbers(df.withColumns({"_short": short, "_role": _role_in(h)}), ["_short", "_role"],
                      [position], F.floor(F.col(position) / HEADER_PIECE), "_n")
    name = F.when(
        F.col("_short").isNotNull(),
        F.concat(F.col("_short"), F.lit("_MC"), F.col("_n"), F.lit("_"), F.col("_role")),
    ).otherwise(F.coalesce(scale, h))
    return out.withColumn("new_name", name).drop("_short", "_role", "_n")


def collisions(df: DataFrame, old: str, new: str) -> DataFrame:
    """New names that more than one old header would take, a row for each header; their number stands beside the first."""
    once = df.select(old, new).distinct()
    many = once.groupBy(new).agg(F.count("*").alias("n_headers")).filter("n_headers > 1")
    texts = ordered_distinct(once.join(many.select(new), new), [new], old, "header")
    return beside_text(many, texts, [new])
