"""Roll-ups of one run's results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.runs.history import entry_time, name_matches
from relweave.runs.results import STATUSES, is_bad

_CHECKED = ("ok", "mismatch", "failed", "error")


def _counts() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]


def pass_rate(ok: Column, total: Column, skipped: Column) -> Column:
    return F.when(total - skipped > 0, ok / (total - skipped))


def summarize(results: DataFrame) -> DataFrame:
    """One row: the count of each status, checked cases, and mean and median seconds."""
    seconds = F.col("duration_ms") / 1000
    status = F.col("status")
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        *_counts(),
        F.count_if(F.col("checked") & status.isin(*_CHECKED)).alias("checked_total"),
        F.count_if(F.col("checked") & (status == "ok")).alias("checked_ok"),
        F.avg(seconds).alias("avg_total_s"),
        F.median(seconds).alias("median_total_s"),
    )


def by_tag(results: DataFrame) -> DataFrame:
    """A row for each tag; a result counts once for each of its tags."""
    tagged = results.select(F.explode(F.array_distinct("tags")).alias("tag"), "status")
    counted = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("total"), *_counts())
    checked = sum((F.col(s) for s in _CHECKED[1:]), F.col(_CHECKED[0]))
    return counted.withColumns({"checked_total": checked, "pass_rate": pass_rate(F.col("ok"), F.col("total"), F.col("skipped"))})


def bad_count(results: DataFrame, fail_on: str = "bad", require_assert: bool = False) -> DataFrame:
    return results.agg(F.count_if(is_bad(F.col("status"), fail_on, require_assert)).alias("bad"))


def tag_inventory(results: DataFrame, planned: DataFrame, fail_on: str = "bad", require_assert: bool = False) -> DataFrame:
    """``tag, planned, executed, missed, bad, pass_rate``: ``planned`` has (tag, id), ``results`` (tag, id, status)."""
    own = results.select("tag", "id", "status")
    joined = planned.select("tag", "id").distinct().join(own, ["tag", "id"], "full")
    known = planned.select("tag", "id", F.lit(1).alias("in_plan")).distinct()
    both = joined.join(known, ["tag", "id"], "left")
    out = both.groupBy("tag").agg(
        F.count("in_plan").alias("planned"),
        F.count("status").alias("executed"),
        F.count_if(F.col("in_plan").isNotNull() & F.col("status").isNull()).alias("missed"),
        F.count_if(is_bad(F.col("status"), fail_on, require_assert)).alias("bad"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )
    return out.select("tag", "planned", "executed", "missed", "bad", pass_rate(F.col("ok"), F.col("executed"), F.col("skipped")).alias("pass_rate"))


def worst_tags(results: DataFrame, n: int = 5, fail_on: str = "bad", require_assert: bool = False) -> DataFrame:
    """Tags with the most failures, lowest pass rate first among equals."""
    tagged = results.select(F.explode(F.array_distinct("tags")).alias("tag"), "status").groupBy("tag").agg(
        F.count_if(is_bad(F.col("status"), fail_on, require_assert)).alias("bad"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "skipped").alias("skipped")
    )
    rated = tagged.select("tag", "bad", pass_rate(F.col("ok"), F.col("total"), F.col("skipped")).alias("pass_rate"))
    return rated.orderBy(F.desc("bad"), F.asc_nulls_last("pass_rate"), "tag").limit(n)


def run_status(interrupted: Column, planned: Column, executed: Column, bad: Column) -> Column:
    return F.when(interrupted, "INTERRUPTED").when(planned != executed, "ERROR").when(bad > 0, "FAILED").otherwise("SUCCESS")


def exit_code(interrupted: Column, bad: Column) -> Column:
    return F.when(interrupted, 130).when(bad > 0, 1).otherwise(0)


def tag_list(entries: DataFrame, pattern: str | None = None, sort: str = "updated", limit: int | None = None) -> DataFrame:
    """``tag, updated, n_runs, n_cases``: tags of history entries with the time of their newest one, newest first (ties and ``sort="name"``: by name)."""
    if sort not in ("updated", "name"):
        raise ValueError(f"Unknown sort {sort!r}")
    own = entries.withColumn("at", entry_time(entries)).filter(F.nullif("tag", F.lit("")).isNotNull() & name_matches(F.col("tag"), pattern))
    out = own.groupBy("tag").agg(F.max("at").alias("updated"), F.count_distinct("run_id").alias("n_runs"), F.count_distinct("case_id").alias("n_cases"))
    out = out.orderBy(*([F.desc_nulls_last("updated")] if sort == "updated" else []), "tag")
    return out.limit(limit) if limit else out
