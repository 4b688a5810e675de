"""Reading a profile: what columns mean and what to do about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts of a column name and what they stand for, tried in this order.
MEANINGS = {
    "id": ["id", "uid", "uuid", "key"],
    "name": ["name", "firstname", "lastname", "fullname"],
    "email": ["email", "mail"],
    "phone": ["phone", "mobile", "tel"],
    "date": ["date", "time", "created", "updated", "hired", "birth"],
    "salary": ["salary", "wage", "pay", "compensation", "income"],
    "age": ["age", "years"],
    "department": ["dept", "department", "division", "team"],
    "location": ["city", "state", "country", "location", "region", "office"],
    "score": ["score", "rating", "performance", "grade"],
    "gender": ["gender", "sex"],
    "nationality": ["nationality", "nation", "citizenship"],
}
PERSONAL = ("name", "email", "phone", "address")


def column_insight(profile: DataFrame) -> DataFrame:
    """Meaning, label, sensitivity, quality notes and suggested steps per profiled column."""
    lower = F.lower("column")
    meaning = F.lit("unknown")
    for kind, parts in reversed(MEANINGS.items()):
        meaning = F.when(reduce(lambda a, b: a | b, [F.contains(lower, F.lit(p)) for p in parts]), kind).otherwise(meaning)
    out = profile.withColumn("semantic_type", meaning)
    steps = F.array_compact(F.array(
        F.when(F.col("missing_pct") > 0, "fill_missing"),
        F.when(F.col("kind") == "numeric", "normalize"),
        F.when((F.col("kind") == "numeric") & (F.abs("skew") > 1), "remove_outliers"),
        F.when(F.col("kind") == "categorical", "standardize_categories")))
    return out.select(
        "column", "semantic_type", F.initcap(F.replace("column", F.lit("_"), F.lit(" "))).alias("label"),
        F.col("semantic_type").isin(*PERSONAL).alias("is_pii"),
        (F.col("missing_pct") > 20).alias("high_missing"), steps.alias("suggested_steps"))


def issue_list(profile: DataFrame) -> DataFrame:
    """Columns with many nulls or a heavy skew, with the step that answers it."""
    many = profile.filter("missing_pct > 30").select(
        "column", F.lit("fill_missing").alias("step"), F.lit("high").alias("priority"), F.col("missing_pct").alias("observed"))
    skewed = profile.filter((F.col("kind") == "numeric") & (F.abs("skew") > 2)).select(
        "column", F.lit("remove_outliers").alias("step"), F.lit("medium").alias("priority"), F.col("skew").alias("observed"))
    return many.unionByName(skewed)


def dataset_insight(insight: DataFrame) -> DataFrame:
    """Columns to join on, and how sensitive the table is."""
    personal = F.count_if("is_pii")
    return insight.agg(
        F.count(F.lit(1)).alias("columns"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("semantic_type") == "id", F.col("column")))), ",").alias("join_candidates"),
        personal.alias("pii_count"),
        F.when(personal > 2, "high").when(personal > 0, "medium").otherwise("low").alias("pii_risk"))
