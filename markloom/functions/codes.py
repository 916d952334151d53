"""Procedure codes in free text: extraction, tags, clean-up, readable names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A code whose tag is fixed, whatever the text says (fixed values)
FIXED_TAGS = {
    "011": "COE",
    "012": "POE",
    "014": "CONSULTATION",
    "022": "I/O RAD",
    "061": "VITALITY",
    "071": "DIAGNOSTIC MODEL",
    "072": "PHOTOS",
    "074": "PHYSICAL MODELS",
    "737": "RESILIENT LINING",
    "741": "ADJUSTMENT",
    "743": "RELINING",
}

# code, word in the text, tag that replaces the base tag (fixed values)
REPLACED_BY_WORD = [
    ("013", "Paeds Specific", "PAEDS SPECIFIC"),
    ("013", "", "LIMITED OE"),
    ("744", "insert", "RELINING INSERT"),
    ("744", "impression", "RELINING PARTIAL"),
]
DENTURE_CODES = ["711", "712", "713", "714"]
DENTURE_STAGES = [
    ("Finish", "FINISH"),
    ("Primary", "PRIMARY"),
    ("Secondary", "SECONDARY"),
    ("Occlusal", "OCCLUSAL"),
    ("Try-in", "TRY-IN"),
    ("review", "REVIEW"),
]

# code, word in the text, words added to the base tag; an empty word always fits (fixed values)
ADDED_BY_WORD = [
    ("121", "remin", "REMIN"),
    ("121", "cariostatic", "CARIOSTATIC"),
    ("416", "+2", "+2"),
    ("416", "+3", "+3"),
    ("416", "", "RCT ADD"),
    ("414", "Cvek", "CVEK"),
    ("414", "Deciduous", "DECIDUOUS"),
]

# the same, but only in simulation (fixed values)
ADDED_IN_SIMULATION = [
    ("415", "Access", "ACCESS"),
    ("415", "Working length", "WORK LENGTH"),
    ("417", "Cone fit", "CONE FIT"),
    ("417", "Root filling", "ROOT FLG"),
    ("418", "Cone fit", "CONE FIT"),
    ("418", "Root filling", "ROOT FLG"),
    ("586", "[Separators]", "SEPARATORS"),
    ("586", "", "TOOTH PREP"),
    ("587", "[Separators]", "SEPARATORS"),
    ("587", "", "TOOTH PREP"),
]
REPLACED_IN_SIMULATION = {"579": "BONDING"}
SKIPPED_CODE = "941"


def base_tag(part: Column, location: Column) -> Column:
    """The second word when it is a setting, else the setting of the form."""
    second = F.get(F.split(part, " "), F.lit(1))
    by_place = F.when(F.coalesce(location, F.lit("")).contains("Simulation"), "SIM").otherwise("CLINIC")
    return F.when(second.isin("SIM", "CLINIC"), second).otherwise(by_place)


def code_tag(code: Column, part: Column, base: Column) -> Column:
    """The tag of one code: the first rule of that code that fits, else the base tag."""
    rules: dict[str, list[tuple[Column, Column]]] = {}
    always, simulated = F.lit(True), base == "SIM"
    has = lambda word: part.contains(word) if word else always
    longer = lambda extra: F.concat(base, F.lit(" " + extra))
    for value, tag in FIXED_TAGS.items():
        rules.setdefault(value, []).append((always, F.lit(tag)))
    for value, word, tag in REPLACED_BY_WORD:
        rules.setdefault(value, []).append((has(word), F.lit(tag)))
    for value in DENTURE_CODES:
        rules.setdefault(value, []).extend((has(word), F.lit(tag)) for word, tag in DENTURE_STAGES)
    for value, word, extra in ADDED_BY_WORD:
        rules.setdefault(value, []).append((has(word), longer(extra)))
    for value, word, extra in ADDED_IN_SIMULATION:
        rules.setdefault(value, []).append((simulated & has(word), longer(extra)))
    for value, tag in REPLACED_IN_SIMULATION.items():
        rules.setdefault(value, []).append((simulated, F.lit(tag)))
    chain = None
    for value, cases in rules.items():
        inner = F.when(*cases[0])
        for condition, tag in cases[1:]:
            inner = inner.when(condition, tag)
        tag = inner.otherwise(base)
        chain = F.when(code == value, tag) if chain is None else chain.when(code == value, tag)
    return F.when(~code.isin(*rules), base).otherwise(chain)


def procedure_codes(service: Column, location: Column, paeds_as_limited: bool = False) -> Column:
    """Comma list of services to an array of (code, tag).

    Each part gives its numbers of three digits or more. The skipped code is left out.
    A tag found for one code stays for the next code of the same part.
    ``paeds_as_limited`` gives code 013 the limited tag whatever the text says.
    """
    parts = F.split(F.coalesce(service, F.lit("")), ",")
    nothing = F.array().cast("array<struct<code:string,tag:string>>")

    def tag_of(code: Column, part: Column, before: Column) -> Column:
        tag = code_tag(code, part, before)
        return F.when(code == "013", "LIMITED OE").otherwise(tag) if paeds_as_limited else tag

    def add(state: Column, code: Column, part: Column) -> Column:
        tag = tag_of(code, part, state["tag"])
        entry = F.struct(code.alias("code"), tag.alias("tag"))
        return F.struct(tag.alias("tag"), F.array_append(state["codes"], entry).alias("codes"))

    def of_part(part: Column) -> Column:
        numbers = F.filter(
            F.regexp_extract_all(part, F.lit(r"\b(\d+)\b"), 1),
            lambda c: (F.length(c) > 2) & (c != SKIPPED_CODE),
        )
        start = F.struct(base_tag(part, location).alias("tag"), nothing.alias("codes"))
        return F.aggregate(numbers, start, lambda s, c: add(s, c, part), lambda s: s["codes"])

    return F.flatten(F.transform(parts, of_part))


def general_services(service: Column) -> Column:
    """Upper-case word and the text in parentheses after it: array of (code, tag)."""
    text = F.coalesce(service, F.lit(""))
    pattern = F.lit(r"\b([A-Z]+)\b.*?\((.*?)\)")
    return F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, pattern, 1).alias("c"),
            F.regexp_extract_all(text, pattern, 2).alias("t"),
        ),
        lambda z: F.struct(z["c"].alias("code"), F.upper(z["t"]).alias("tag")),
    )


def code_key(code: Column, tag: Column) -> Column:
    return F.when(tag.isNull() | (tag == ""), code).otherwise(F.concat(code, F.lit("_"), tag))


def clean_codes(entry: Column) -> Column:
    """One raw entry to valid codes: LA flag, ``022 x 4`` multiplied, long runs cut in threes.

    One-digit numbers are dropped; a two-digit number is padded only when it comes first;
    a run whose length is no multiple of three gets one leading zero, and an incomplete
    last piece is dropped.
    """
    text = F.coalesce(entry, F.lit(""))
    la = F.when(F.upper(text).contains("LA"), F.array(F.lit("LA"))).otherwise(F.array().cast("array<string>"))
    pattern = F.lit(r"(\d+)(?:\s*[xX]\s*(\d+))?")
    found = F.arrays_zip(
        F.regexp_extract_all(text, pattern, 1).alias("d"),
        F.regexp_extract_all(text, pattern, 2).alias("m"),
    )

    long_enough = F.filter(found, lambda z: F.length(z["d"]) > 1)

    def one(z: Column, i: Column) -> Column:
        digits = z["d"]
        n = F.length(digits)
        run = (
            F.when((n > 3) & (n % 3 != 0), F.concat(F.lit("0"), digits))
            .when((n == 2) & (i == 0), F.concat(F.lit("0"), digits))
            .otherwise(digits)
        )
        pieces = F.when(F.length(run) >= 3, F.regexp_extract_all(run, F.lit(r"(\d{3})"), 1)).otherwise(
            F.array().cast("array<string>")
        )
        times = F.coalesce(F.nullif(z["m"], F.lit("")).try_cast("int"), F.lit(1))
        return F.flatten(F.transform(pieces, lambda p: F.array_repeat(p, times)))

    return F.concat(la, F.flatten(F.transform(long_enough, one)))


def short_codes(text: Column) -> Column:
    """Three digits with an optional run of capitals."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\d{3}[A-Z]*)\b"), 1)


def readable_code(item: Column) -> Column:
    """A three-digit number, else a padded short number (also ``a/b``), else the first three words."""
    pad = lambda x: F.lpad(x, 3, "0")
    tokens = F.split(F.trim(item), r"\s+")
    return (
        F.when(item.rlike(r"\b\d{3}\b"), F.regexp_extract(item, r"\b(\d{3})\b", 1))
        .when(item.rlike(r"^\d{1,2}$"), pad(item))
        .when(item.rlike(r"^\d{1,2}[/-]\d{1,2}$"),
              F.array_join(F.transform(F.split(item, "[/-]"), pad), "/"))
        .when(item.rlike(r"^\d+$"), item)
        .when(F.size(tokens) > 3, F.array_join(F.slice(tokens, 1, 3), " "))
        .otherwise(item)
    )


def items_of_services(columns: list[Column], local_anaesthetic: Column | None = None) -> Column:
    """All services of a form as one array, with LA added where it was given."""
    lists = [
        F.when(c.isNull() | c.isin("", "nan"), F.array().cast("array<string>")).otherwise(
            F.transform(F.split(c, ","), lambda x: F.trim(x))
        )
        for c in columns
    ]
    items = F.flatten(F.array(*lists))
    if local_anaesthetic is None:
        return items
    return F.when(local_anaesthetic == "Yes", F.array_append(items, F.lit("LA"))).otherwise(items)
