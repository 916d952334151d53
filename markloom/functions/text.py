"""String rules: levels, ages, patients, teeth, categories, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom import constants as K


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group, or null where the pattern is not found."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def lenient_number(text: Column) -> Column:
    return text.try_cast("double")


def rubric_level(text: Column) -> Column:
    """``Lvl 3 ...`` to 3; null where no level is named."""
    return extract(text, r"Lvl (\d+)").try_cast("int")


def rubric_level_or_zero(text: Column) -> Column:
    return F.coalesce(rubric_level(text), F.lit(0))


def phrase_level(text: Column, levels: dict[str, int | None] | None = None) -> Column:
    """Competency phrase to its level; other texts become null."""
    levels = K.COMPETENCY_LEVELS if levels is None else levels
    known = {k: v for k, v in levels.items() if v is not None}
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.create_map(*pairs)[text]


def age_band(age: Column) -> Column:
    (n0, _, h0), (n1, _, h1), (n2, l2, h2) = K.AGE_BANDS
    return F.when(age <= h0, n0).when(age <= h1, n1).when((age >= l2) & (age <= h2), n2)


def numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("bigint"))


def patient_count(text: Column) -> Column:
    """The highest number named, else 0."""
    return F.coalesce(F.array_max(numbers_in(text)), F.lit(0).cast("bigint"))


def failed_to_attend(text: Column, strict: bool = False) -> Column:
    """True where no patient came. ``strict``: any mention counts, and so does a text without number."""
    named = F.coalesce(F.lower(text).contains("fta"), F.lit(False))
    no_number = F.coalesce(~text.rlike(r"\d"), F.lit(False))
    return (no_number | named) if strict else (no_number & named)


def tooth_number(text: Column) -> Column:
    return extract(text, r"\bTOOTH (\d+)\b")


def standard_tooth(text: Column) -> Column:
    found = F.lit(None).cast("string")
    plain = F.lower(F.trim(text))
    for key, tooth in reversed(K.STANDARD_TEETH):
        found = F.when(plain.contains(key), tooth).otherwise(found)
    return found


def absence_reason(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(t.isNull(), F.lit(None))
        .when(t.contains("cancel") | t.contains("fta"), "Cancellation")
        .when(t.contains("no ") & t.contains("book"), "No Booking")
        .when(t.contains("fill"), "Unable to Fill")
        .when(t.contains("assistant"), "Assigned as Assistant")
        .otherwise("Other")
    )


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.upper(F.left(w, F.lit(1)))), "")


def strip_non_ascii(text: Column) -> Column:
    """Drop control characters except line feed and tab, and all beyond ASCII."""
    return F.regexp_replace(text, r"[^\x09\x0A\x20-\x7E]", "")


def keep_word_characters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9 .,\-]", "")


def plain_punctuation(text: Column) -> Column:
    """Typographic quotes and dashes to ASCII, the ellipsis to three dots, the rest dropped."""
    dots = F.replace(text, F.lit("\u2026"), F.lit("..."))
    flat = F.translate(dots, "‘’“”–— ", "''\"\"-- ")
    return F.regexp_replace(flat, r"[^\x00-\x7F]", "")


def clean_header(text: Column) -> Column:
    return F.lower(F.trim(F.translate(text, " ", " ")))


def joined_pair(a: Column, b: Column) -> Column:
    """``a, b`` without loose commas."""
    return F.trim(F.concat(F.coalesce(a, F.lit("")), F.lit(", "), F.coalesce(b, F.lit(""))), F.lit(", "))


def other_if_other(choice: Column, other: Column, label: str = "Other") -> Column:
    return F.when(choice == label, other).otherwise(choice)


def polarity(word: Column) -> Column:
    pairs = [F.lit(x) for kv in K.POLARITY_WORDS.items() for x in kv]
    return F.create_map(*pairs)[word]


def words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]+)"), 1)


def site_word(text: Column) -> Column:
    """Merge all emergency clinics under one name."""
    return F.when(F.lower(text).contains("emergency"), "PC Emergency").otherwise(text)
