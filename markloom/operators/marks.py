"""Checklist marks: counts, best of repeated markings, section results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.functions import outcome as O
from markloom.functions import scoring as S


def outcome_counts(answers: DataFrame, keys: list[str], outcome: str = "outcome") -> DataFrame:
    """Yes, No, NA and not-filled counts per key."""
    return answers.groupBy(*keys).agg(*O.counts(F.col(outcome)))


def roll_up(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Add counts up to a coarser key."""
    return counts.groupBy(*keys).agg(*O.sum_counts())


def checklist_scores(counts: DataFrame, decimals: int | None = None) -> DataFrame:
    """Add ``checklist_score`` to counts."""
    return counts.withColumn(
        "checklist_score", S.checklist_score(F.col("n_yes"), F.col("n_no"), F.col("n_na"), decimals)
    )


def best_of(counts: DataFrame, forms: DataFrame, form: str, person: str, day: str,
            question: list[str]) -> DataFrame:
    """One outcome per (person, day, question) over repeated markings.

    ``counts`` is answers already counted per (form, question), so a form with very many
    answers is small before it meets ``forms``.
    """
    marks = counts.join(forms.select(form, person, day), form)
    merged = marks.groupBy(person, day, *question).agg(*O.sum_counts())
    best = O.merged_from_counts(F.col("n_yes"), F.col("n_no"), F.col("n_na"))
    return merged.select(person, day, *question, best.alias("outcome"))


def best_of_forms(forms: DataFrame, person: str, day: str, levels: list[str], flags: list[str]) -> DataFrame:
    """Rubric levels by maximum and incident flags by any-Yes over repeated markings."""
    return forms.groupBy(person, day).agg(
        *[F.max(c).alias(c) for c in levels],
        *[O.any_yes(F.col(c)).alias(c) for c in flags],
        F.count("*").alias("n_forms"),
    )


def student_means(best: DataFrame, person: str, day: str) -> DataFrame:
    """Checklist score per day, then the mean per person."""
    daily = checklist_scores(outcome_counts(best, [person, day]))
    return daily.groupBy(person).agg(F.avg("checklist_score").alias("mean_score"), F.count("*").alias("n_days"))


def section_table(counts: DataFrame, person: str, section: str, sub: str, threshold: float = 80.0,
                  all_label: str = "All") -> DataFrame:
    """Counts and % Yes per sub-section and per section, with the below-threshold flag."""
    grouped = counts.groupingSets([[person, section, sub], [person, section]], person, section, sub).agg(
        F.grouping(sub).alias("_all"),
        F.sum("n_yes").alias("n_yes"), F.sum("n_no").alias("n_no"), F.sum("n_na").alias("n_na"),
    )
    pct = S.percent_yes(F.col("n_yes"), F.col("n_no"))
    return (
        grouped.withColumn(sub, F.when(F.col("_all") == 1, all_label).otherwise(F.col(sub)))
        .withColumn("pct_yes", pct)
        .withColumn("below_threshold", F.when(F.col("pct_yes") < threshold, "Yes").when(F.col("pct_yes").isNotNull(), "No"))
        .drop("_all")
    )


def weighted_sections(answers: DataFrame, keys: list[str], weight: str, outcome: str = "outcome") -> DataFrame:
    """Yes weight over reviewed weight, in percent, with Yes and No counts."""
    reviewed = F.col(outcome).isin("Yes", "No")
    return answers.groupBy(*keys).agg(
        F.count_if(F.col(outcome) == "Yes").alias("n_yes"),
        F.count_if(F.col(outcome) == "No").alias("n_no"),
        F.coalesce(F.sum(F.when(F.col(outcome) == "Yes", F.col(weight))), F.lit(0)).alias("weight_yes"),
        F.coalesce(F.sum(F.when(reviewed, F.col(weight))), F.lit(0)).alias("weight_reviewed"),
    ).withColumn("score", F.try_divide(F.col("weight_yes") * F.lit(100.0), F.col("weight_reviewed").cast("double")))


def criterion_scores(answers: DataFrame, keys: list[str], probability: str, weight: str,
                     outcome: str = "outcome") -> DataFrame:
    """Cutoff, weighted cutoff and weighted score over the reviewed questions of a form."""
    reviewed = answers.filter(F.col(outcome).isin("Yes", "No"))
    sums = reviewed.groupBy(*keys).agg(
        F.count("*").alias("n_reviewed"),
        F.sum(probability).alias("_p"),
        F.sum(F.col(probability) * F.col(weight)).alias("_pw"),
        F.sum(weight).alias("denominator"),
        F.coalesce(F.sum(F.when(F.col(outcome) == "Yes", F.col(weight))), F.lit(0)).alias("weighted_sum"),
    )
    return sums.withColumns({
        "cutoff": F.col("_p") / F.col("n_reviewed"),
        "weighted_cutoff": F.try_divide(F.col("_pw").cast("double"), F.col("denominator").cast("double")),
        "weighted_score": F.try_divide(F.col("weighted_sum") * F.lit(100.0), F.col("denominator").cast("double")),
    }).drop("_p", "_pw")


def thermometer(levels: DataFrame, keys: list[str], level: str, highest: int) -> DataFrame:
    """Level L as rows step 1..highest with bit 1 up to L (missing counts as 0)."""
    return levels.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(highest)))).select(
        *keys, "step", (F.coalesce(F.col(level), F.lit(0)) >= F.col("step")).cast("int").alias("bit")
    )


def two_markings(forms: DataFrame, person: str, order, values: list[str]) -> DataFrame:
    """Persons with exactly two markings, both on one line, and first minus second.

    Two rows per person are reached by ``min_by`` and ``max_by``, so nothing is sorted or joined.
    """
    cells = []
    for v in values:
        cells += [F.min_by(v, order).alias(f"{v}_1"), F.max_by(v, order).alias(f"{v}_2")]
    two = forms.groupBy(person).agg(F.count("*").alias("_n"), *cells).filter("_n = 2").drop("_n")
    return two.withColumns({f"{v}_diff": F.col(f"{v}_1") - F.col(f"{v}_2") for v in values if
                            dict(forms.dtypes)[v] in ("int", "bigint", "double", "float")})
