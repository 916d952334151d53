"""Summary tables of a whole cohort and of each of its clinics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markloom import constants as K
from markloom.functions import scoring as S
from markloom.operators.ordering import top_rows
from markloom.operators.stats import safe_corr

ALL = "All"


def by_subset(df: DataFrame, subset: str, others: list[str], *cells: Column) -> DataFrame:
    """Aggregate per subset and once for everything, in one pass over the data."""
    sets = [[subset, *others], list(others)]
    out = df.groupingSets(sets, subset, *others).agg(F.grouping(subset).alias("_g"), *cells)
    return out.withColumn(subset, F.when(F.col("_g") == 1, ALL).otherwise(F.col(subset))).drop("_g")


def front_table(forms: DataFrame, questions: DataFrame, codes: DataFrame, subset: str, person: str) -> DataFrame:
    """The front page of a report, a row per clinic and one for all.

    ``forms``: person, n_patients, is_fta, role, level, stu_score, sup_score.
    ``questions``: qno, n_yes, n_no (counted per form). ``codes``: a row per item code.
    """
    operator = F.col("role") == "Operator"
    main = by_subset(
        forms, subset, [],
        F.count("*").alias("n_forms"), F.countDistinct(person).alias("n_students"),
        F.countDistinct(F.when(operator, F.col(person))).alias("n_operator_students"),
        F.count_if(operator).alias("n_operator_forms"),
        F.sum("n_patients").alias("n_patients"), F.count_if(F.col("is_fta")).alias("n_fta"),
        *[F.count_if(F.col("level") == i).alias(f"level_{i}") for i in (1, 2, 3, 4)],
        F.avg(F.col("stu_score") - F.col("sup_score")).alias("mean_score_difference"),
        safe_corr(F.when(F.col("level") > 0, F.col("level")), F.col("sup_score")).alias("level_score_correlation"),
    )
    main = main.withColumns({
        "patients_per_student": F.col("n_patients") / (F.col("n_operator_students") + F.lit(K.EPSILON_PATIENTS)),
        "patients_per_form": F.try_divide(F.col("n_patients").cast("double"), F.col("n_operator_forms").cast("double")),
    })
    seen = by_subset(forms, subset, [person], F.sum("n_patients").alias("_p"))
    spread = seen.groupBy(subset).agg(F.max("_p").alias("most_patients"), F.min("_p").alias("fewest_patients"))
    asked = by_subset(questions, subset, ["qno"], F.sum("n_yes").alias("y"), F.sum("n_no").alias("n")).withColumn(
        "score", S.ratio_with_epsilon(F.col("y"), F.col("n")))
    ends = asked.groupBy(subset).agg(
        F.max_by("qno", F.struct("score", (-F.col("qno")).alias("k"))).alias("best_question"),
        F.min_by("qno", F.struct("score", "qno")).alias("worst_question"))
    counted = by_subset(codes, subset, ["code"], F.count("*").alias("n"))
    top = top_rows(counted, [subset], [F.desc("n"), "code"], 5).groupBy(subset).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "code", "n"))),
                                 lambda x: F.concat(x["code"], F.lit(": "), x["n"])), "\n").alias("top_codes"))
    return main.join(spread, subset, "left").join(ends, subset, "left").join(top, subset, "left")


def clinics_as_columns(table: DataFrame, subset: str, metrics: list[str], clinics: list[str]) -> DataFrame:
    """One row per metric, one column per clinic."""
    cells = table.select(subset, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cells.unpivot(subset, metrics, "metric", "value").groupBy("metric").pivot(subset, clinics).agg(F.first("value"))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, lowest and highest."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("lowest"), F.max(value).alias("highest"))


def histogram(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """Counts per bin of a fixed width; ``bin`` is its lower edge."""
    bin_ = (F.floor(F.col(value) / F.lit(float(width))) * F.lit(float(width))).alias("bin")
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, bin_).agg(F.count("*").alias("n"))


def ends_per_group(df: DataFrame, group: str, item: str, score: str, k: int) -> DataFrame:
    """The ``k`` best and ``k`` worst items of each group, with their place."""
    scored = df.filter(F.col(score).isNotNull())
    best = top_rows(scored, [group], [F.desc(score), item], k, "place").withColumn("end", F.lit("best"))
    worst = top_rows(scored, [group], [score, item], k, "place").withColumn("end", F.lit("worst"))
    return best.unionByName(worst)


def against_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each row's value beside the mean of its key; the means are joined, not gathered in a window."""
    means = df.groupBy(key).agg(F.avg(value).alias(f"mean_{value}"))
    return df.join(means, key)
