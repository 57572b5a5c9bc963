"""Loaders of labelled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_classification(spark: SparkSession, path: str, label: str, key: str, schema: str, most: int | None = None) -> DataFrame:
    """key, x, y of a CSV file: rows with nulls are dropped, labels are coded in sorted order, features that are no numbers are 0.

    ``most``: only the first rows in the order of ``key``, nulls among them, are looked at.
    """
    rows = spark.read.csv(path, header=True, schema=schema)
    if most is not None:
        rows = rows.orderBy(key).limit(most)
    rows = rows.na.drop()
    codes = rows.select(label).distinct()  # as many rows as classes
    codes = codes.withColumn("y", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    features = [F.coalesce(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(0.0)) for c in rows.columns if c not in (label, key)]
    return rows.join(F.broadcast(codes), label).select(key, F.array(*features).alias("x"), "y")


def unit_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns scaled to 0..1 over the whole table; without a range the divisor is 1."""
    ends = df.agg(*[e for c in columns for e in (F.min(c).alias(f"_a_{c}"), F.max(c).alias(f"_b_{c}"))])
    span = lambda c: F.when(F.col(f"_b_{c}") > F.col(f"_a_{c}"), F.col(f"_b_{c}") - F.col(f"_a_{c}")).otherwise(1.0)
    rows = df.join(F.broadcast(ends))  # one row
    return rows.select(*[((F.col(c) - F.col(f"_a_{c}")) / span(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
