"""The four-valued outcome: Yes, No, NA, or not filled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom import constants as K


def normalise(answer: Column, not_reviewed_as: str = "NA") -> Column:
    """Free answer text to ``Yes``/``No``/``NA``, null where nothing was filled.

    ``not_reviewed_as`` is the fill policy: ``NA`` keeps half weight, ``No`` counts against.
    """
    return (
        F.when(answer.isNull() | answer.isin(*K.BLANK), F.lit(None))
        .when(answer.isin(*K.POSITIVE), "Yes")
        .when(answer.isin(*K.NEGATIVE), "No")
        .when(answer.isin(*K.NOT_REVIEWED), not_reviewed_as)
        .when(answer == K.NOT_ASSESSED, "NA")
        .otherwise(answer)
    )


def as_number(outcome: Column) -> Column:
    """1 for Yes, 0 for No, null for NA and not filled."""
    return F.when(outcome == "Yes", 1).when(outcome == "No", 0)


def counts(outcome: Column, prefix: str = "n_") -> list[Column]:
    """Yes, No, NA and not-filled counts as one pass of aggregates."""
    return [
        F.count_if(outcome == "Yes").alias(f"{prefix}yes"),
        F.count_if(outcome == "No").alias(f"{prefix}no"),
        F.count_if(outcome == "NA").alias(f"{prefix}na"),
        F.count_if(outcome.isNull()).alias(f"{prefix}blank"),
    ]


def sum_counts(prefix: str = "n_", out: str | None = None) -> list[Column]:
    """Roll counts made by :func:`counts` up to a coarser key."""
    out = prefix if out is None else out
    return [F.sum(f"{prefix}{k}").alias(f"{out}{k}") for k in ("yes", "no", "na", "blank")]


def merged(outcome: Column) -> Column:
    """Best of repeated markings: a lone value stays, otherwise Yes beats No."""
    return (
        F.when(F.count_if(outcome == "Yes") > 0, "Yes")
        .when(F.count_if(outcome == "No") > 0, "No")
        .when(F.min(outcome) == F.max(outcome), F.max(outcome))
    )


def merged_from_counts(yes: Column, no: Column, na: Column) -> Column:
    """The same rule when the markings were already counted."""
    return F.when(yes > 0, "Yes").when(no > 0, "No").when(na > 0, "NA")


def any_yes(flag: Column) -> Column:
    return F.when(F.coalesce(F.bool_or(flag == "Yes"), F.lit(False)), "Yes").otherwise("No")
