"""Rows from a position on, without bringing all rows before it, or all rows, into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.plans.materialize import materialize
from relweave.plans.scope import quoted

#: Rows up to this position are found by a bounded sort on the driver's side; beyond, or without a limit, by `skip`.
TOP = 100_000


def sort_columns(order: Sequence[tuple[Column, bool]]) -> list[Column]:
    """``order``: columns and whether they descend; nulls are last either way."""
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]


def _keys(order: Sequence[tuple[Column, bool]], tie: Sequence[str]) -> list[tuple[Column, bool]]:
    return [*order, *([(F.xxhash64(*[F.col(quoted(c)) for c in tie]), False)] if tie else [])]


def skip(df: DataFrame, order: Sequence[tuple[Column, bool]], offset: int, tie: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df`` from position ``offset`` (counted from 0) on, in order.

    The sort keys alone are counted and range-partitioned; the partitions' totals, one number each, tell in which of them the position lies, and
    a running sum over that partition which key stands there. The rows from that key on are a filter of ``df``. Jobs are run
    for this when the query is put together.

    Rows with equal keys are told apart by a hash of the columns ``tie``; rows that agree in that too may be skipped in any order.
    An offset of 0 skips nothing, one beyond the end everything.
    """
    keys = _keys(order, tie)
    if not offset or not keys:
        return df.orderBy(*sort_columns(keys)) if keys else df.offset(offset)
    names = [f"key{i}" for i in range(len(keys))]
    by = sort_columns([(F.col(n), down) for n, (_, down) in zip(names, keys)])
    counts = df.select(*[c.alias(n) for n, (c, _) in zip(names, keys)]).groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    counts = materialize(counts.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "keys", by="part")
    before = 0
    for r in counts.groupBy("part").agg(F.sum("rows").alias("rows")).orderBy("part").collect():  # a row a partition
        if before + r["rows"] > offset:
            part, before = r["part"], offset - before
            break
        before += r["rows"]
    else:
        return df.filter(F.lit(False))
    run = F.sum("rows").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))  # of one range partition
    edge = materialize(counts.filter(F.col("part") == part).withColumn("run", run).filter(F.col("run") > before).orderBy("run").limit(1), "edge")
    lost = before - edge.select(F.col("run") - F.col("rows")).first()[0]

    at = edge.select(F.struct(*names)).scalar()
    same = [c.eqNullSafe(at[n]) for n, (c, _) in zip(names, keys)]
    later = [((c < at[n]) if down else (c > at[n])) | (c.isNull() & at[n].isNotNull()) for n, (c, down) in zip(names, keys)]
    beyond = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [*same[:i], F.coalesce(x, F.lit(False))]) for i, x in enumerate(later)])
    equal = reduce(lambda a, b: a & b, same)
    if not lost:
        out = df.filter(beyond | equal)
    else:
        number = F.row_number().over(Window.orderBy(F.lit(1)))  # of the rows with one key
        out = df.filter(beyond).unionByName(df.filter(equal).withColumn("row number", number).filter(F.col("`row number`") > lost).drop("row number"))
    return out.orderBy(*sort_columns(keys))


def page(df: DataFrame, order: Sequence[tuple[Column, bool]], limit: int | None, offset: int, tie: Sequence[str] = ()) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ``df`` in order, ties told apart as in `skip`; in no order if there is neither an order nor an offset."""
    if offset and (limit is None or offset + limit > TOP):
        df, offset = skip(df, order, offset, tie), 0
    elif (order or offset) and (keys := _keys(order, tie)):
        df = df.orderBy(*sort_columns(keys))
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)
