"""Valid versions of rows that arrive several times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The row of each key with the latest ``at``: ``key`` and ``columns``.

    One aggregate with a map-side half, no window sort of the whole table. Rows of one key with equal
    ``at`` are ordered by ``columns`` (nulls first), so repeated rows and ties give one defined row.
    Rows with a null key have no identity and are left out; a null ``at`` loses against any other.
    """
    rest = [F.col(c) for c in columns]
    best = F.max(F.struct(F.col(at).alias("__at"), *[c.alias(f"__c{i}") for i, c in enumerate(rest)]))
    out = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(best.alias("__best"))
    return out.select(F.col("__key").alias(key), *[F.col(f"__best.__c{i}").alias(c) for i, c in enumerate(columns)])


def cents(amount: Column) -> Column:
    """Whole cents of an amount; null and NaN count as 0."""
    return F.when(amount.isNull() | F.isnan(amount), F.lit(0)).otherwise(F.round(amount * 100)).cast("long")
