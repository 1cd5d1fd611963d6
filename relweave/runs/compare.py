"""Two runs side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.runs.results import STATUSES, is_bad, reason
from relweave.runs.summary import summarize


def _side(results: DataFrame, name: str) -> DataFrame:
    return results.select("id", F.col("status").alias(name), reason(results).alias(f"{name}_reason"))


def diff_runs(base: DataFrame, new: DataFrame, fail_on: str = "bad", require_assert: bool = False) -> DataFrame:
    """``id, from, to, reason, outcome, changed, is_new`` of every case of either run.

    ``outcome`` is new_fail, fixed, still_fail or null. A case that is missing in the new run counts as bad there; a case that is
    new and bad is a new failure.
    """
    both = _side(base, "b").join(_side(new, "n"), "id", "full")
    was, gone = is_bad(F.col("b"), fail_on, require_assert), F.col("n").isNull()
    now = gone | is_bad(F.col("n"), fail_on, require_assert)
    fresh = F.col("b").isNull()
    return both.select(
        "id",
        F.col("b").alias("from"),
        F.coalesce("n", F.lit("missing")).alias("to"),
        F.when(gone, "missing in new results").otherwise(F.col("n_reason")).alias("reason"),
        F.when(~was & now, "new_fail").when(was & ~now, "fixed").when(was & now, "still_fail").alias("outcome"),
        (~fresh & ~F.col("b").eqNullSafe(F.col("n"))).alias("changed"),
        fresh.alias("is_new"),
    )


def count_deltas(base: DataFrame, new: DataFrame, fail_on: str = "bad", require_assert: bool = False) -> DataFrame:
    """``metric, base, new, delta`` of the counts, failures, coverage and times of two runs."""

    def side(results: DataFrame, name: str) -> DataFrame:
        s = summarize(results.withColumn("checked", F.lit(False)) if "checked" not in results.columns else results)
        metrics = ["total", *STATUSES]
        bad = sum((F.col(x) for x in STATUSES if x in _bad(fail_on, require_assert)), F.lit(0))
        rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics]
        rows += [F.struct(F.lit("bad").alias("metric"), bad.cast("double").alias(name)), *[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in ("avg_total_s", "median_total_s")]]
        return s.select(F.inline(F.array(*rows)))

    return side(base, "base").join(side(new, "new"), "metric").withColumn("delta", F.col("new") - F.col("base"))


def _bad(fail_on: str, require_assert: bool) -> list[str]:
    from relweave.runs.results import bad_statuses

    return bad_statuses(fail_on, require_assert)


def coverage_counts(base: DataFrame, new: DataFrame) -> DataFrame:
    both = base.select("id", F.lit(1).alias("b")).join(new.select("id", F.lit(1).alias("n")), "id", "full")
    return both.agg(F.count("b").alias("base_total"), F.count("n").alias("new_total"), F.count_if(F.col("n").isNull()).alias("only_in_base"), F.count_if(F.col("b").isNull()).alias("only_in_new"))


def effective_diff(before: DataFrame, after: DataFrame, fail_on: str = "bad", require_assert: bool = False) -> DataFrame:
    """``id, from, to, reason, change``: regressed, fixed, changed_bad, changed_other or new_case. Cases that vanish are not reported."""
    both = _side(after, "n").join(_side(before, "b").drop("b_reason"), "id", "left")
    was, now = is_bad(F.col("b"), fail_on, require_assert), is_bad(F.col("n"), fail_on, require_assert)
    change = (
        F.when(F.col("b").isNull(), "new_case")
        .when(F.col("b") == F.col("n"), None)
        .when(~was & now, "regressed")
        .when(was & ~now, "fixed")
        .when(was & now, "changed_bad")
        .otherwise("changed_other")
    )
    return both.select("id", F.col("b").alias("from"), F.col("n").alias("to"), F.col("n_reason").alias("reason"), change.alias("change")).filter("change is not null")


def upsert(effective: DataFrame, executed: DataFrame) -> DataFrame:
    """The snapshot with every executed result in the place of the older one."""
    kept = effective.join(executed.select("id").distinct(), "id", "left_anti")
    return kept.unionByName(executed.select(*kept.columns))


def check_snapshot(meta: dict | None, cases_hash: str, scope_hash: str) -> None:
    """A snapshot of other cases or another scope must not be merged into."""
    for name, value in (("cases_hash", cases_hash), ("scope_hash", scope_hash)):
        if meta and meta.get(name) and meta[name] != value:
            raise ValueError(f"The snapshot has another {name}; refusing to merge")


def missed(planned: DataFrame, *executed: DataFrame) -> DataFrame:
    """Planned ids that no run executed."""
    out = planned.select("id").distinct()
    for e in executed:
        out = out.join(e.select("id"), "id", "left_anti")
    return out
