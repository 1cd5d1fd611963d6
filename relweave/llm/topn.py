"""Top N items within every group, by descending score bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.plans.materialize import materialize

#: Shares of all rows that lie in or above each band; the last band goes down to the least score.
BANDS = (1 / 64, 1 / 16, 1 / 4)


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int, shares: tuple[float, ...] = BANDS, scores: DataFrame | None = None) -> DataFrame:
    """``group, tie, score, rank``: the first ``n`` rows of each group by score descending, then tie ascending (nulls last).

    The scores are range-partitioned into bands. From the top, each band's rows of groups that aren't filled yet (anti-join)
    are ranked exactly, and a group takes as many as it still lacks; equal scores are always in one band. Inside a band a
    task passes on no more than ``n`` rows of a group (the rank limit is applied before the shuffle too), so a group
    with a third of all rows is not gathered anywhere. Where the bands lie (approximate quantiles of ``scores``, a column of about the same
    distribution that is cheaper to read, else of ``df``) changes the work, not the result; the rows are written once, by band.

    Defined cases: rows with a null group, or a null or NaN score, don't take part; a group with fewer rows gives
    all; repeated rows count as often as they stand; an empty table gives no rows; other columns are not looked at.
    """
    rows = df.select(F.col(group).alias("g"), F.col(score).alias("s"), F.col(tie).alias("t")).filter("g is not null and s is not null and not isnan(cast(s as double))")
    # numbers that aren't one count as the least score here
    level = F.col((scores if scores is not None else rows).columns[0 if scores is not None else 1])
    seen = (rows if scores is None else scores).select(F.when(~F.isnan(level.cast("double")), level).alias("s"))
    found = seen.agg(F.percentile_approx("s", [1 - s for s in shares], 1000)).first()[0] if shares else None
    cuts = sorted(set(found or ()), reverse=True)
    taken: list[DataFrame] = []
    order = Window.partitionBy("g").orderBy(F.desc("s"), F.asc_nulls_last("t"))
    number = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        number = F.when(F.col("s") >= cut, i).otherwise(number)
    banded = materialize(rows.withColumn("band", number), "bands", by="band")
    for i in range(len(cuts) + 1):
        band = banded.filter(F.col("band") == i).drop("band")  # reads this band's files only
        if taken:
            have = reduce(DataFrame.unionByName, taken).groupBy("g").agg(F.count(F.lit(1)).alias("have"))
            band = band.join(have.filter(F.col("have") >= n).select("g"), "g", "left_anti")
        best = band.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n)
        if taken:
            best = best.join(have, "g", "left").withColumn("r", F.col("r") + F.coalesce("have", F.lit(0))).filter(F.col("r") <= n).drop("have")
        taken.append(materialize(best.select("g", "t", "s", "r"), "band"))
    return reduce(DataFrame.unionByName, taken).select(F.col("g").alias(group), F.col("t").alias(tie), F.col("s").alias(score), F.col("r").alias("rank"))
