"""Totals over trailing periods for every entity and calendar day, idle days included."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.plans.materialize import materialize

#: Dense rows that one task sorts, and most tasks (beyond, a task sorts more and spills).
ROWS_A_TASK, MOST_TASKS = 1_500_000, 50_000


def rolling_totals(df: DataFrame, entity: str, day: str, amount: str, start: dt.date, end: dt.date, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """``entity, day, amount`` and ``total_n``, ``avg_n`` for each trailing period of n days, for each day from start to end.

    ``amount`` is an integer column (such as cents). First the rows are added up by entity and day, which takes a hot entity
    down to one row a day on the map side; only these compact rows are shuffled. Each entity then meets the calendar
    after the shuffle, inside its partition, so the dense table (entities x days) is never moved. The days on which any period can
    hold a row, those from an active day on for as long as the longest period, are made dense and go through window sums over
    the n-1 preceding rows; where such a stretch ends, its last rows are idle days, so a window that reaches back over a gap meets zeros only. All
    other days of the calendar are idle for every period and are added with totals of 0. The number of partitions follows the dense size.

    Defined cases: rows with a null entity or day, or a day outside the calendar, don't take part; a null amount counts
    as 0; an entity without rows in the calendar doesn't appear; at the calendar's start a period is as long as
    there are days, but averages are per n days; an empty table gives no rows.
    """
    days = (end - start).days + 1
    if days < 1:
        raise ValueError("the calendar is empty")
    longest = max(periods)
    rows = df.select(F.col(entity).alias("__e"), F.datediff(F.col(day), F.lit(start)).alias("__d"), F.coalesce(F.col(amount), F.lit(0)).cast("long").alias("__a"))
    rows = rows.filter(F.col("__e").isNotNull() & F.col("__d").between(0, days - 1))
    daily = materialize(rows.groupBy("__e", "__d").agg(F.sum("__a").alias("__a")), "daily")
    width = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, math.ceil(daily.count() * min(days, longest) / ROWS_A_TASK)))
    along = Window.partitionBy("__e").orderBy("__d")
    sparse = daily.repartition(width, "__e").select("__e", "__d", "__a", F.lead("__d", 1, days).over(along).alias("__next"), F.lag("__d").over(along).alias("__last"))
    until = F.least(F.col("__d") + longest, F.col("__next")) - 1
    dense = sparse.select("__e", "__d", "__a", F.explode(F.sequence("__d", until)).alias("__x")).select("__e", F.when(F.col("__x") == F.col("__d"), F.col("__a")).otherwise(0).alias("__a"), F.col("__x").alias("__d"))
    sums = [F.sum("__a").over(along.rowsBetween(1 - n, 0)).alias(f"total_{n}") for n in periods]
    busy = dense.select("__e", "__d", "__a", *sums)
    none = F.array().cast("array<int>")
    before = F.when(F.col("__last").isNull() & (F.col("__d") > 0), F.sequence(F.lit(0), F.col("__d") - 1)).otherwise(none)
    after = F.when(F.col("__d") + longest < F.col("__next"), F.sequence(F.col("__d") + longest, F.col("__next") - 1)).otherwise(none)
    zero = F.lit(0).cast("long")
    idle = sparse.select("__e", F.explode(F.concat(before, after)).alias("__d")).select("__e", "__d", zero.alias("__a"), *[zero.alias(f"total_{n}") for n in periods])
    out = busy.unionByName(idle)
    return out.select(
        F.col("__e").alias(entity),
        F.date_add(F.lit(start), F.col("__d")).alias(day),
        F.col("__a").alias(amount),
        *[F.col(f"total_{n}") for n in periods],
        *[(F.col(f"total_{n}") / n).alias(f"avg_{n}") for n in periods],
    )
