"""Running cases through an agent, and the folder that keeps their results: one run after another, with a history and a snapshot of each tag.

    FOLDER/results/<run>   results of a run, JSON lines
    FOLDER/cases           a history entry a case and run, appended
    FOLDER/runs            an entry a run, appended
    FOLDER/tags/<tag>/<n>  versions of the newest result of each case under a tag; the last one counts

A case is a call of a model, so cases are asked one by one from the driver; everything else is frames.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.functions.text import answer_check, case_status
from relweave.runs import compare, history, results, summary

#: Asks one question; a text, or none if only a plan was made.
Ask = Callable[[str], str | None]
RUN = "run_id string, timestamp string, config_hash string, run_status string, pass_rate double, planned_total long, executed_total long, fail_count long, missed_total long, interrupted boolean, tag string, scope_hash string, note string"


class Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str) -> tuple[Any, Any]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def names(self, part: str) -> list[str]:
        """Names below a part of the folder; none where it isn't there yet."""
        fs, p = self._fs(f"{self.path}/{part}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def runs(self) -> DataFrame:
        return results.read_history(self.spark, f"{self.path}/runs", RUN) if self.names("runs") else self.spark.createDataFrame([], RUN)

    def cases(self) -> DataFrame:
        return results.read_history(self.spark, f"{self.path}/cases") if self.names("cases") else self.spark.createDataFrame([], results.HISTORY)

    def results(self, run: str) -> DataFrame:
        return results.read_results(self.spark, f"{self.path}/results/{run}")

    def latest(self, tag: str | None = None) -> DataFrame | None:
        """Results of the newest run, of a tag if one is named."""
        own = self.runs() if tag is None else self.runs().filter(F.col("tag") == tag)
        last = history.last_runs(own, 1).first()
        return self.results(last["run_id"]) if last else None

    def snapshot(self, tag: str) -> DataFrame | None:
        versions = [int(n) for n in self.names(f"tags/{tag}") if n.isdigit()]
        return self.spark.read.schema(results.RESULT).json(f"{self.path}/tags/{tag}/{max(versions)}") if versions else None

    def keep(self, run: str, done: DataFrame, entry: dict[str, Any]) -> None:
        """A finished run: its results, its history entries, and its tag's snapshot."""
        results.write_results(done, f"{self.path}/results/{run}")
        done = self.results(run)
        tag, at = entry["tag"], entry["timestamp"]
        lit = lambda v: F.lit(v).cast("string")
        results.append_history(done.select(F.col("id").alias("case_id"), lit(run).alias("run_id"), lit(tag).alias("tag"), lit(entry["scope_hash"]).alias("scope_hash"), lit(at).alias("ts"), "status", "reason", "duration_ms"), f"{self.path}/cases")
        results.append_history(self.spark.createDataFrame([entry], RUN), f"{self.path}/runs")
        if tag:
            before = self.snapshot(tag)
            number = 1 + max([int(n) for n in self.names(f"tags/{tag}") if n.isdigit()], default=0)
            merged = done if before is None else compare.upsert(before.select(done.columns), done)
            results.write_results(merged, f"{self.path}/tags/{tag}/{number}")


def run_batch(folder: Folder, cases: DataFrame, ask: Ask, *, tag: str | None = None, note: str | None = None, fail_on: str = "bad", require_assert: bool = False, max_fails: int | None = None, plan_only: bool = False, scope: str = "", config: str | None = None) -> tuple[str, dict[str, Any]]:
    """Ask all cases (`results.read_cases`), keep what comes out; the run's id and its entry. Stops at ``max_fails`` errors or when interrupted."""
    spark, run = folder.spark, f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:6]}"
    rows, planned, fails, interrupted = [], cases.count(), 0, False
    try:
        for c in cases.orderBy("id").toLocalIterator():
            began, answer, error = time.monotonic(), None, None
            if not c["skip"]:
                try:
                    answer = ask(c["question"])
                except Exception as e:  # noqa: BLE001 - an error is a result
                    error = f"{type(e).__name__}: {e}"
                    fails += 1
            rows.append((c["id"], answer, error, int(1000 * (time.monotonic() - began))))
            if max_fails is not None and fails >= max_fails:
                break
    except KeyboardInterrupt:
        interrupted = True
    said = spark.createDataFrame(rows, "id string, answer string, error string, duration_ms long").join(cases, "id")
    check = answer_check(F.col("answer"), F.col("expected"), F.col("expected_regex"), F.col("expected_contains"))
    none = F.col("answer").isNull() & F.lit(plan_only)
    done = said.withColumn("check", F.when(~none, check)).select(
        "id", "question", "answer", "error", "duration_ms", "tags",
        F.when(F.col("skip"), "skipped").otherwise(case_status(F.col("error"), F.col("check.passed"), none)).alias("status"),
        F.col("check").isNotNull().alias("checked"),
        F.lit("").alias("reason"),
    )
    done = spark.createDataFrame(done.collect(), done.schema)  # as many rows as calls were made
    one = summary.summarize(done).first()
    bad = summary.bad_count(done, fail_on, require_assert).first()["bad"]
    status, rest = "INTERRUPTED" if interrupted else "ERROR" if planned != len(rows) else "FAILED" if bad else "SUCCESS", one["total"] - one["skipped"]
    entry = {
        "run_id": run, "timestamp": f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%S.%fZ}", "config_hash": config, "run_status": status, "pass_rate": one["ok"] / rest if rest else None, "planned_total": planned,
        "executed_total": len(rows), "fail_count": bad, "missed_total": planned - len(rows), "interrupted": interrupted, "tag": tag, "scope_hash": scope, "note": note,
    }
    folder.keep(run, done, entry)
    return run, entry
