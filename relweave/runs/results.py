"""Result, case and history records as JSON lines."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("ok", "mismatch", "failed", "error", "skipped", "unchecked", "plan_only")
#: A result as it stands in a file.
RESULT = """id string, question string, status string, checked boolean, reason string, details string, artifacts_dir string, duration_ms long,
 tags array<string>, answer string, error string, plan_path string, timings struct<plan_s: double, fetch_s: double, synth_s: double, total_s: double>,
 expected_check struct<mode: string, expected: string, passed: boolean, detail: string>"""
CASE = "id string, question string, expected string, expected_regex string, expected_contains string, tags array<string>, skip boolean"
HISTORY = "case_id string, run_id string, tag string, scope_hash string, ts string, timestamp string, status string, note string, reason string, duration_ms long"


def bad_statuses(fail_on: str = "bad", require_assert: bool = False) -> list[str]:
    """Statuses that count as failures under a policy."""
    unchecked = {"unchecked", "plan_only"}
    bad = {"error"} if fail_on == "error" else {"error", "failed", "mismatch"}
    if fail_on in ("unchecked", "any") or require_assert:
        bad |= unchecked
    if fail_on == "skipped":
        bad.add("skipped")
    return sorted(bad)


def is_bad(status: Column, fail_on: str = "bad", require_assert: bool = False) -> Column:
    return F.coalesce(status.isin(bad_statuses(fail_on, require_assert)), F.lit(False))


def reason(df: DataFrame) -> Column:
    """The first of reason, error and the check's detail that says something."""
    said = [F.nullif(F.col(c), F.lit("")) for c in ("reason", "error") if c in df.columns]
    if "expected_check" in df.columns:
        said.append(F.nullif(F.col("expected_check.detail"), F.lit("")))
    return F.coalesce(*said, F.lit(""))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of a JSON-lines file. Bad JSON fails when it is read; an id that stands twice is an error.

    ``duration_ms`` falls back to the total time, a check implies ``checked``, a missing status is an error.
    """
    raw = spark.read.schema(RESULT).option("mode", "FAILFAST").json(path)
    twice = raw.groupBy("id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"Duplicate result id {twice[0]['id']!r}")
    return raw.withColumns(
        {
            "status": F.coalesce("status", F.lit("error")),
            "duration_ms": F.coalesce("duration_ms", (F.col("timings.total_s") * 1000).cast("long"), F.lit(0)),
            "checked": F.coalesce("checked", F.lit(False)) | F.col("expected_check").isNotNull(),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
        }
    )


def write_results(df: DataFrame, path: str) -> None:
    """JSON lines in the order of ids, with sorted keys; range partitions keep the order over several files."""
    df.select(sorted(df.columns)).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_history(spark: SparkSession, path: str, schema: str = HISTORY) -> DataFrame:
    """An append-only log; lines that can't be read are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON-lines file or of one JSON array, checked for missing fields, repeated ids, empty expectations and bad patterns."""
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    reader = spark.read.schema(CASE).option("mode", "FAILFAST")
    cases = reader.option("multiLine", bool(head and head["c"] == "[")).json(path)
    checks = ("expected", "expected_regex", "expected_contains")
    problem = F.when(F.col("id").isNull() | F.col("question").isNull(), "missing required fields 'id' and 'question'")
    for c in checks:
        problem = problem.when(F.trim(c) == "", f"{c} must not be empty")
    bad = cases.withColumn("problem", problem).filter("problem is not null").limit(1).collect()
    if bad:
        raise ValueError(f"Case {bad[0]['id']!r}: {bad[0]['problem']}")
    if twice := cases.groupBy("id").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"Duplicate case id {twice[0]['id']!r}")
    for r in cases.select("expected_regex").filter("expected_regex is not null").distinct().toLocalIterator():
        try:
            re.compile(r[0])
        except re.error as e:
            raise ValueError(f"Invalid expected_regex {r[0]!r}: {e}") from e
    return cases.withColumns({"tags": F.coalesce("tags", F.array().cast("array<string>")), "skip": F.coalesce("skip", F.lit(False))})


def scope_hash(cases_hash: str, include_tags: Iterable[str] | None = None, exclude_tags: Iterable[str] | None = None, include_ids: Iterable[str] | None = None, exclude_ids: Iterable[str] | None = None) -> str:
    """Identity of a selection, whatever the order of its parts."""
    parts: Mapping[str, object] = {"cases_hash": cases_hash, "include_tags": include_tags, "exclude_tags": exclude_tags, "include_ids": include_ids, "exclude_ids": exclude_ids}
    canonical = {k: (v if isinstance(v, str) else sorted(v) if v else None) for k, v in parts.items()}
    return hashlib.sha256(json.dumps(canonical, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
