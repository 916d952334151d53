"""Chat formatting (operator 7)."""

from __future__ import annotations

from dataclasses import dataclass
from re import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """What stands before and after a role's text, and whether the text counts for the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role; ``other`` serves every other role, with the role's name between ``other.before`` and ``name_end``.

    ``controls`` are the strings that must not stand in a text as they are; each mark holds one. ``next_roles`` are the
    moves of the machine that checks the order of turns, from "start"; a conversation may end in ``final``.
    """

    turns: dict[str, Turn]
    other: Turn
    name_end: str
    controls: tuple[str, ...]
    next_roles: dict[str, tuple[str, ...]]
    final: tuple[str, ...]


# The marks of a widely used chat format.
INST = Template(
    turns={"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s> ", "</s>", True)},
    other=Turn("[TURN ", "[/TURN]"), name_end="] ",
    controls=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[TURN", "[/TURN]"),
    next_roles={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)


def _at_controls(t: Template, removed: str) -> str:
    """A pattern for the place after the first character of a control string, backslashes before its rest allowed."""
    rest: dict[str, list[str]] = {}
    for c in t.controls:
        rest.setdefault(c[0], []).append(c[1:])
    return "|".join(rf"(?<={escape(first)}){removed}(?=\\*(?:{'|'.join(map(escape, tails))}))" for first, tails in rest.items())


def escaped(t: Template, text: Column) -> Column:
    """A text in which no control string stands: a backslash, or one more, goes after its first character."""
    return F.regexp_replace(text, _at_controls(t, ""), "\\\\")


def unescaped(t: Template, text: Column) -> Column:
    return F.regexp_replace(text, _at_controls(t, r"\\"), "")


def validates(t: Template, roles: Column) -> Column:
    """Whether the roles are a walk of the template's machine from the start to a final state."""
    def move(state: Column, role: Column) -> Column:
        out = F.lit("bad")
        for source, ends in t.next_roles.items():
            out = F.when((state == source) & role.isin(*ends), role).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start"), lambda s, r: move(s, F.coalesce(r, F.lit("")))).isin(*t.final)


def format_conversations(rows: DataFrame, template: Template = INST) -> DataFrame:
    """conv_id, n_turns, formatted, segments, valid_order: one formatted text for each conversation.

    ``segments`` are (text, loss) end to end; together they are ``formatted``. Control strings in texts are escaped,
    reversibly. ``valid_order`` is the verdict of the machine over the roles; no conversation is dropped for it.
    Rows go by turn, then role and text, nulls first; repeated rows are turns of their own. A null text is empty, a
    null role is the empty name, rows with a null conv_id are one conversation. Unknown roles carry their name in
    hexadecimal. Other columns are ignored; an empty table gives no rows. A conversation is one text, so it is held whole.
    """
    t = template
    other = F.concat(F.lit(t.other.before), F.lower(F.hex(F.encode("role", "UTF-8"))), F.lit(t.name_end))
    pick = lambda known, rest: F.coalesce(*[F.when(F.col("role") == r, known(v)) for r, v in t.turns.items()], rest)
    marked = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).select(
        "conv_id", F.struct("turn", "role", "text", pick(lambda v: F.lit(v.before), other).alias("before"), escaped(t, F.col("text")).alias("body"),
                            pick(lambda v: F.lit(v.after), F.lit(t.other.after)).alias("after"),
                            pick(lambda v: F.lit(v.loss), F.lit(t.other.loss)).alias("loss")).alias("t"))
    whole = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    return whole.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.concat_ws("", F.transform("turns", lambda x: F.concat(x["before"], x["body"], x["after"]))).alias("formatted"),
        F.flatten(F.transform("turns", lambda x: F.array(segment(x["before"], no), segment(x["body"], x["loss"]), segment(x["after"], no)))).alias("segments"),
        validates(t, F.col("turns.role")).alias("valid_order"))


def read_back(formatted: DataFrame, template: Template = INST) -> DataFrame:
    """Add ``roles`` and ``texts``, parsed from ``formatted``, and ``loss_text``, all text under the loss mask."""
    t = template
    opens = "|".join([*(escape(v.before) for v in t.turns.values()), rf"{escape(t.other.before)}[0-9a-f]*{escape(t.name_end)}"])
    closes = "|".join([*(escape(v.after) for v in t.turns.values()), escape(t.other.after)])
    pattern = F.lit(f"(?s)({opens})(.*?)({closes})")
    name = lambda o: F.decode(F.unhex(F.substring(o, F.lit(len(t.other.before) + 1), F.length(o) - len(t.other.before + t.name_end))), "UTF-8")
    role = lambda o: F.coalesce(*[F.when(o == v.before, F.lit(r)) for r, v in t.turns.items()], name(o))
    return formatted.select(
        "*", F.transform(F.regexp_extract_all("formatted", pattern, F.lit(1)), role).alias("roles"),
        F.transform(F.regexp_extract_all("formatted", pattern, F.lit(2)), lambda x: unescaped(t, x)).alias("texts"),
        F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(t, s["text"]))).alias("loss_text"))
