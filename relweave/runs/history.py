"""Histories of cases and runs, and which cases to run again."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.functions.text import epoch_seconds
from relweave.runs.results import is_bad


def entry_time(df: DataFrame) -> Column:
    """Seconds of ``ts``, else of ``timestamp``, else of ``fallback_ts``, of those that the frame has."""
    return F.coalesce(*[epoch_seconds(F.col(c).cast("string")) for c in ("ts", "timestamp", "fallback_ts") if c in df.columns], F.lit(None).cast("double"))


def newest_per_run(history: DataFrame, tag: str | None = None, scope_hash: str | None = None, strict_scope: bool = False) -> DataFrame:
    """One entry for each case and run, the newest; an overlay entry (``is_overlay``) wins a tie. Entries without a run don't count.

    Under a scope, entries of other scopes are left out, and with ``strict_scope`` also those without one. Adds ``at`` and
    ``recency`` (1 is a case's newest run).
    """
    own = history.filter(F.nullif("run_id", F.lit("")).isNotNull())
    if tag is not None:
        own = own.filter(F.col("tag") == tag)
    if scope_hash:
        same = F.col("scope_hash") == scope_hash
        own = own.filter(same if strict_scope else (same | F.col("scope_hash").isNull()))
    if "is_overlay" not in own.columns:
        own = own.withColumn("is_overlay", F.lit(False))
    own = own.withColumn("at", entry_time(own))
    best = Window.partitionBy("case_id", "run_id").orderBy(F.desc_nulls_last("at"), F.desc("is_overlay"), F.asc_nulls_last("status"))
    one = own.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")
    newest = Window.partitionBy("case_id").orderBy(F.desc_nulls_last("at"), F.desc("run_id"))
    return one.withColumn("recency", F.row_number().over(newest))


def healed(history: DataFrame, passes: int, fail_on: str = "bad", require_assert: bool = False) -> DataFrame:
    """``case_id`` of the cases whose newest ``passes`` runs are all good. ``history``: of `newest_per_run`."""
    last = history.filter(F.col("recency") <= passes)
    good = ~is_bad(F.col("status"), fail_on, require_assert)
    return last.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(good).alias("good")).filter((F.col("n") == passes) & F.col("good")).select("case_id")


def only_failed(baseline: DataFrame, overlay: DataFrame, healed_ids: DataFrame | None = None, fail_on: str = "bad", require_assert: bool = False) -> DataFrame:
    """Failures of the baseline that aren't healed, and failures of the overlay. Without ``healed_ids`` one good overlay result heals."""

    def bad(df: DataFrame) -> DataFrame:
        return df.filter(is_bad(F.col("status"), fail_on, require_assert)).select("id")

    good = overlay.filter(~is_bad(F.col("status"), fail_on, require_assert)).select("id")
    if healed_ids is not None:  # only what the overlay ran can be healed
        good = overlay.select("id").join(healed_ids.select(F.col("case_id").alias("id")), "id", "left_semi")
    return bad(baseline).join(good, "id", "left_anti").unionByName(bad(overlay)).distinct()


def only_missed(selected: DataFrame, baseline: DataFrame, overlay: DataFrame | None, *, overlay_scope: str | None = None, scope: str | None = None, overlay_tag: str | None = None, tag: str | None = None) -> DataFrame:
    """Selected ids that neither run executed; an overlay of another scope or tag is left aside."""
    out = selected.select("id").distinct().join(baseline.select("id"), "id", "left_anti")
    other = (overlay_scope and scope and overlay_scope != scope) or (overlay_tag and tag and overlay_tag != tag)
    return out if overlay is None or other else out.join(overlay.select("id"), "id", "left_anti")


def select_cases(cases: DataFrame, include_tags: list[str] | None = None, exclude_tags: list[str] | None = None, include_ids: list[str] | None = None, exclude_ids: list[str] | None = None) -> DataFrame:
    """Cases by tags and ids; an empty list says nothing."""
    tags = lambda names: F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    rules = []
    if include_tags:
        rules.append(tags(include_tags))
    if exclude_tags:
        rules.append(~tags(exclude_tags))
    if include_ids:
        rules.append(F.col("id").isin(include_ids))
    if exclude_ids:
        rules.append(~F.col("id").isin(exclude_ids))
    return cases.filter(reduce(lambda a, b: a & b, rules)) if rules else cases


def name_matches(c: Column, pattern: str | None) -> Column:
    """A glob, or a regular expression after ``re:``; no pattern matches all."""
    if not pattern:
        return F.lit(True)
    if pattern.startswith("re:"):
        return F.regexp_like(c, F.lit(pattern[3:]))
    # translate() gives (?s:...)\Z
    return F.regexp_like(c, F.lit("^" + fnmatch.translate(pattern).replace("\\Z", "").replace("\\z", "") + "$"))


def last_runs(history: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """The newest ``n`` runs of a run history, of each value of ``by`` where one is named (none is ``unknown``)."""
    rows = history.withColumn("at", entry_time(history))
    if by is None:
        return rows.orderBy(F.desc_nulls_last("at"), F.desc("run_id")).limit(n)
    group = F.coalesce(F.col(by).cast("string"), F.lit("unknown"))
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last("at"), F.desc("run_id"))
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).drop("rn")


def run_stats(history: DataFrame) -> DataFrame:
    """Rows of a run history with numbers read from whatever type they have, coverage, and a status."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    return history.select(
        "run_id",
        F.coalesce(F.nullif("run_status", F.lit("")), F.when(F.col("interrupted"), "INTERRUPTED"), F.lit("UNKNOWN")).alias("status"),
        F.coalesce("tag", F.lit("")).alias("tag"),
        number("fail_count").cast("long").alias("bad"),
        number("pass_rate").alias("pass_rate"),
        F.try_divide(number("executed_total"), number("planned_total")).alias("coverage"),
        number("missed_total").alias("missed"),
    )
