"""Scores, weights, penalties and ratios."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom import constants as K


def _d(value: float) -> Column:
    return F.lit(float(value))


def half_even(value: Column, decimals: int | None) -> Column:
    """Round exact halves to the even digit; ``None`` leaves the value alone."""
    return value if decimals is None else F.bround(value, decimals)


def checklist_score(yes: Column, no: Column, na: Column, decimals: int | None = None) -> Column:
    """(Yes + half NA) / (Yes + No + half NA); null when nothing was answered."""
    credit = _d(K.NA_WEIGHT) * na
    return half_even(F.try_divide(yes + credit, yes + no + credit), decimals)


def percent_yes(yes: Column, no: Column) -> Column:
    return F.try_divide(yes * _d(100.0), (yes + no).cast("double"))


def ratio_with_epsilon(part: Column, rest: Column, epsilon: float = K.EPSILON_SCORE) -> Column:
    """part / (part + rest + epsilon), which never reaches 1."""
    return part / (part + rest + _d(epsilon))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Sum of value x weight over the sum of all weights, a missing value counting 0."""
    total = sum(w for _, w in parts)
    value = _d(0.0)
    for column, weight in parts:
        value = value + F.coalesce(column.cast("double"), _d(0.0)) * _d(weight)
    return value / _d(total)


def weighted_sum(parts: list[tuple[Column, float]]) -> Column:
    """Sum of value x weight; the one form behind every published score variant."""
    value = _d(0.0)
    for column, weight in parts:
        value = value + F.coalesce(column.cast("double"), _d(0.0)) * _d(weight)
    return value


def rubric_score(levels: Mapping[str, Column], setting: Column, decimals: int | None = None) -> Column:
    """Weighted rubric in [0, 1]; weights and denominators depend on the setting.

    Only the rubrics in ``levels`` take part, so absent scales drop out of the weights.
    """
    by_setting = {}
    for name in ("Simulation", "Clinic"):
        value, weights = _d(0.0), 0.0
        for place, rubric, weight, denominator in K.RUBRIC_SETTINGS:
            if place == name and rubric in levels:
                level = F.coalesce(levels[rubric], F.lit(0))
                value = value + level * _d(weight) / _d(denominator)
                weights += weight
        by_setting[name] = value / _d(weights)
    score = F.when(setting.contains("Simulation"), by_setting["Simulation"]).otherwise(by_setting["Clinic"])
    return half_even(score, decimals)


def total_score(checklist: Column, rubric: Column, decimals: int | None = None) -> Column:
    return half_even(checklist * _d(K.CHECKLIST_WEIGHT) + rubric * _d(K.RUBRIC_WEIGHT), decimals)


def penalised(score: Column, incident: Column, factor: float) -> Column:
    """Reduce the score where the incident value is Yes."""
    return score * F.when(incident == "Yes", _d(factor)).otherwise(_d(1.0))


def clip01(value: Column) -> Column:
    return F.greatest(_d(0.0), F.least(_d(1.0), value))


def importance_band(weight: Column) -> Column:
    band = F.lit(None).cast("string")
    for name, low, high in K.IMPORTANCE_BANDS:
        band = F.when(weight.between(low, high), name).otherwise(band)
    return band


def tooth_item_weight(tooth: Column, item: Column) -> Column:
    weight = F.lit(None).cast("double")
    for t, name, w in K.TOOTH_ITEM_WEIGHTS:
        weight = F.when((tooth == t) & (item == name), _d(w)).otherwise(weight)
    return weight


def cents(amount: Column) -> Column:
    """Two-decimal money as whole cents: sums then do not depend on row order."""
    return F.round(amount * _d(100.0)).cast("bigint")
