"""Per-key results where a few keys hold most rows: eager aggregation through joins.

Joining first and grouping afterwards sends every row of a hot key to one task. Here both inputs are
aggregated by the join key before the join (each map task sends at most one compact state per key, so a
key that holds a third of all rows costs as much as one that holds ten), the states are joined one to
one, and the joined result follows by algebra: counts multiply, sums multiply with the other side's count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eager_join_aggregate(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None, sums: dict[str, str] | None = None, how: str = "left", right_sums: dict[str, str] | None = None) -> DataFrame:
    """What ``left JOIN right ON key GROUP BY key`` gives, without the join of rows.

    ``sums`` and ``right_sums``: output name to a SQL expression over ``left`` or ``right`` that gives an integer or decimal. Result: ``key_value``,
    ``n_left`` and ``n_right`` (rows of each side), ``n_joined`` (rows of the join) and each sum over the rows
    of the join: a side's own sum times the rows that the other side has. ``how``: ``inner`` or ``left``.

    Defined cases: rows with a null key form one state with a null ``key_value`` that joins nothing (``left``
    keeps it, ``inner`` drops it); repeated rows count as they stand; a sum over nulls only is null; an
    empty left side gives no rows; other columns of either side are never looked at, so their names can't clash.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    sums, right_sums = sums or {}, right_sums or {}
    own = left.select(F.col(key).alias("__k"), *[F.expr(e).alias(f"__s{i}") for i, e in enumerate(sums.values())])
    a = own.groupBy("__k").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__s{i}").alias(f"__s{i}") for i in range(len(sums))])
    other = right.select(F.col(right_key or key).alias("__rk"), *[F.expr(e).alias(f"__r{i}") for i, e in enumerate(right_sums.values())]).filter("__rk is not null")
    b = other.groupBy("__rk").agg(F.count(F.lit(1)).alias("__m"), *[F.sum(f"__r{i}").alias(f"__r{i}") for i in range(len(right_sums))])
    times = F.coalesce("__m", F.lit(1)) if how == "left" else F.col("__m")
    return a.join(b, a["__k"] == b["__rk"], how).select(
        F.col("__k").alias("key_value"),
        F.col("__n").alias("n_left"),
        F.coalesce("__m", F.lit(0)).alias("n_right"),
        (F.col("__n") * times).alias("n_joined"),
        *[(F.col(f"__s{i}") * times).alias(name) for i, name in enumerate(sums)],
        *[(F.col(f"__r{i}") * F.col("__n")).alias(name) for i, name in enumerate(right_sums)],
    )


def with_field_total(states: DataFrame) -> DataFrame:
    """Roll the states up by ``field`` and put each field's row total beside its keys as ``n_field``.

    The rolled-up side has one row a field, so it is broadcast by its nature.
    """
    totals = states.groupBy(F.col("field").alias("__f")).agg(F.sum("n_left").alias("n_field"))
    return states.join(F.broadcast(totals), states["field"] == totals["__f"]).drop("__f")


def hot_keys(df: DataFrame, key: str, percent: int = 1) -> list:
    """Non-null keys that hold at least ``percent`` % of the rows: at most ``100 / percent`` values, at any size."""
    total = df.count()
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).count()
    return [r["k"] for r in counts.filter(F.col("count") * 100 >= F.lit(total * percent)).orderBy(F.desc("count"), "k").limit(100 // percent).collect()]
