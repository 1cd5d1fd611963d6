"""Run analytics over small runs with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from relweave.runs import compare, history, report, results, summary
from relweave.streaming import history as stream


def run(spark, **status):
    rows = [(i, s, s in ("ok", "mismatch", "failed", "error"), 1000 * (n + 1), ["t"], None, None) for n, (i, s) in enumerate(status.items())]
    return spark.createDataFrame(rows, "id string, status string, checked boolean, duration_ms long, tags array<string>, reason string, error string")


@pytest.fixture(scope="module")
def two(spark):
    base = run(spark, ok_to_bad="ok", err_to_ok="error", still_bad="mismatch", missing_ok="ok", missing_bad="failed")
    new = run(spark, ok_to_bad="mismatch", err_to_ok="ok", still_bad="failed", new_ok="ok", new_bad="failed")
    return base, new


def ids(df, col="id"):
    return sorted(r[col] for r in df.collect())


def test_diff(two):
    d = compare.diff_runs(*two)
    of = lambda o: ids(d.filter(F.col("outcome") == o))
    assert of("new_fail") == ["missing_ok", "new_bad", "ok_to_bad"] and of("fixed") == ["err_to_ok"] and of("still_fail") == ["missing_bad", "still_bad"]
    assert ids(d.filter("is_new")) == ["new_bad", "new_ok"]
    assert ids(d.filter("changed")) == ["err_to_ok", "missing_bad", "missing_ok", "ok_to_bad", "still_bad"]
    row = d.filter("id = 'missing_ok'").first()
    assert (row["to"], row["reason"]) == ("missing", "missing in new results")


def test_policies(two):
    assert results.bad_statuses() == ["error", "failed", "mismatch"]
    assert results.bad_statuses("error") == ["error"]
    assert results.bad_statuses("any") == results.bad_statuses("unchecked") == results.bad_statuses("bad", True) == ["error", "failed", "mismatch", "plan_only", "unchecked"]
    assert "skipped" in results.bad_statuses("skipped")
    assert ids(compare.diff_runs(*two, fail_on="error").filter("outcome = 'new_fail'")) == ["missing_bad", "missing_ok"]
    assert summary.bad_count(two[1]).first()[0] == 3


def test_effective(spark, two):
    base, new = two
    d = {r["id"]: r["change"] for r in compare.effective_diff(base, new).collect()}
    assert d == {"ok_to_bad": "regressed", "err_to_ok": "fixed", "still_bad": "changed_bad", "new_ok": "new_case", "new_bad": "new_case"}
    merged = {r["id"]: r["status"] for r in compare.upsert(base, new).collect()}
    assert len(merged) == 7 and merged["err_to_ok"] == "ok" and merged["missing_ok"] == "ok"
    compare.check_snapshot({"cases_hash": "a", "scope_hash": "b"}, "a", "b")
    compare.check_snapshot(None, "a", "b")
    for bad in (("x", "b"), ("a", "x")):
        with pytest.raises(ValueError, match="refusing"):
            compare.check_snapshot({"cases_hash": "a", "scope_hash": "b"}, *bad)


def test_summary(spark):
    r = run(spark, c1="ok", c2="unchecked", c3="mismatch")
    s = summary.summarize(r).first()
    assert (s["checked_ok"], s["checked_total"], s["unchecked"], s["total"], s["avg_total_s"], s["median_total_s"]) == (1, 2, 1, 3, 2.0, 2.0)
    t = summary.by_tag(r).first()
    assert (t["tag"], t["total"], t["checked_total"], round(t["pass_rate"], 3)) == ("t", 3, 2, 0.333)
    assert summary.by_tag(run(spark, a="skipped")).first()["pass_rate"] is None
    assert summary.summarize(r.limit(0)).first()["avg_total_s"] is None


def test_selections(spark):
    base, overlay = run(spark, a="failed", b="failed"), run(spark, a="ok", c="failed")
    assert ids(history.only_failed(base, overlay)) == ["b", "c"]
    planned = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "id string")
    assert ids(history.only_missed(planned, run(spark, a="ok"), run(spark, c="ok"))) == ["b"]
    assert ids(history.only_missed(planned, run(spark, a="ok"), run(spark, c="ok"), overlay_scope="x", scope="y")) == ["b", "c"]
    assert ids(history.only_missed(planned, run(spark, a="ok"), run(spark, c="ok"), overlay_tag="x", tag="y")) == ["b", "c"]
    assert ids(compare.missed(planned, run(spark, b="ok"))) == ["a", "c"]


def entries(spark, *rows):
    return spark.createDataFrame([("a", *r) for r in rows], "case_id string, run_id string, ts string, status string, tag string, scope_hash string")


def test_antiflake(spark):
    healed = lambda *rows, n=2: ids(history.healed(history.newest_per_run(entries(spark, *rows)), n), "case_id")
    one = ("r1", "2024-01-01T00:00:00Z", "ok", "t", "s")
    assert healed(one, ("r1", "2024-01-02T00:00:00Z", "ok", "t", "s")) == []
    assert healed(("r3", "2024-01-03T00:00:00+00:00", "ok", "t", "s"), ("r1", "2024-01-01", "failed", "t", "s"), ("r2", "1704153600", "ok", "t", "s")) == ["a"]
    assert healed(one, ("r2", "2024-01-02T00:00:00Z", "failed", "t", "s")) == []
    assert healed(one, (None, "2024-01-02T00:00:00Z", "ok", "t", "s"), ("", "2024-01-02T00:00:00Z", "ok", "t", "s")) == []


def test_scope_and_overlay(spark):
    rows = entries(spark, ("r1", "1", "ok", "t", "s"), ("r2", "2", "ok", "t", None), ("r3", "3", "ok", "t", "x"), ("r4", "4", "ok", "u", "s"))
    assert ids(history.newest_per_run(rows, "t", "s"), "run_id") == ["r1", "r2"]
    assert ids(history.newest_per_run(rows, "t", "s", strict_scope=True), "run_id") == ["r1"]
    tie = entries(spark, ("r1", "1", "failed", "t", "s"), ("r1", "1", "ok", "t", "s")).withColumn("is_overlay", F.col("status") == "ok")
    assert history.newest_per_run(tie).first()["status"] == "ok"


def test_cases_by_tags_and_names(spark):
    cases = spark.createDataFrame([("a1", ["x"]), ("a2", ["x", "y"]), ("b1", []), ("b2", None)], "id string, tags array<string>")
    assert ids(history.select_cases(cases)) == ["a1", "a2", "b1", "b2"]
    assert ids(history.select_cases(cases, include_tags=["x"], exclude_tags=["y"])) == ["a1"]
    assert ids(history.select_cases(cases, exclude_tags=["x"], exclude_ids=["b1"])) == ["b2"]
    for pattern, want in (("a*", 2), ("?1", 2), ("re:^b", 2), ("[ab]2", 2), (None, 4), ("a", 0), ("a.", 0)):
        assert cases.filter(history.name_matches(F.col("id"), pattern)).count() == want, pattern


def test_files(spark, tmp_path):
    good = [{"id": "b", "status": "ok", "timings": {"total_s": 1.5}, "expected_check": {"mode": "exact", "passed": True}}, {"id": "a", "duration_ms": 7, "tags": ["x"]}]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(map(json.dumps, good)) + "\n\n")
    got = {r["id"]: (r["status"], r["duration_ms"], r["checked"], r["tags"]) for r in results.read_results(spark, str(path)).collect()}
    assert got == {"b": ("ok", 1500, True, []), "a": ("error", 7, False, ["x"])}
    results.write_results(results.read_results(spark, str(path)), str(tmp_path / "out"))
    assert results.read_results(spark, str(tmp_path / "out")).count() == 2
    path.write_text(json.dumps({"id": "a"}) + "\n" + json.dumps({"id": "a"}))
    with pytest.raises(ValueError, match="Duplicate result id"):
        results.read_results(spark, str(path))
    path.write_text('{"id": "a"}\n{broken')
    with pytest.raises(Exception, match="(?i)malformed"):
        results.read_results(spark, str(path)).collect()
    log = tmp_path / "log"
    log.mkdir()
    (log / "x.jsonl").write_text('{"case_id": "a", "run_id": "1"}\n{broken\n')
    results.append_history(spark.createDataFrame([("b", "2")], "case_id string, run_id string"), str(log))
    assert ids(results.read_history(spark, str(log)).filter("case_id is not null"), "case_id") == ["a", "b"]


def test_case_files(spark, tmp_path):
    def read(text):
        (tmp_path / "c").write_text(text)
        return results.read_cases(spark, str(tmp_path / "c"))

    one = {"id": "1", "question": "q", "expected_regex": "a+"}
    assert read(json.dumps(one)).count() == 1
    assert read("  " + json.dumps([one, {"id": "2", "question": "q", "tags": ["x"]}], indent=1)).count() == 2
    for bad in ({"id": "1"}, {**one, "expected": " "}, {**one, "expected_regex": "("}):
        with pytest.raises(ValueError):
            read(json.dumps(bad))
    with pytest.raises(ValueError, match="Duplicate"):
        read(json.dumps(one) + "\n" + json.dumps(one))


def test_reports(two):
    c = report.compare(*two)
    assert c.coverage == {"base_total": 5, "new_total": 5, "only_in_base": 2, "only_in_new": 2}
    assert c.counts["bad"] == {"base": 3.0, "new": 3.0, "delta": 0.0}
    assert "| ok_to_bad | ok → mismatch |" in report.markdown(c) and "Top fixes:\n  - err_to_ok" in report.table(c)
    assert [r["id"] for r in json.loads(report.as_json(c))["top_regressions"]] == ["missing_ok", "new_bad", "ok_to_bad"]
    xml = report.junit(c)
    assert 'tests="7"' in xml and 'failures="5"' in xml


def test_run_history(spark):
    h = spark.createDataFrame([("1", "2024-01-01", "a", None, "0.5", "4", "2", "1", "2", False), ("2", "2024-01-03", "a", "FAILED", "x", "0", "2", None, None, False), ("3", "2024-01-02", None, None, None, None, None, None, None, True)], "run_id string, timestamp string, config_hash string, run_status string, pass_rate string, planned_total string, executed_total string, fail_count string, missed_total string, interrupted boolean").withColumn("tag", F.lit(None).cast("string"))
    assert [r["run_id"] for r in history.last_runs(h, 2).collect()] == ["2", "3"]
    assert ids(history.last_runs(h, 1, "config_hash"), "run_id") == ["2", "3"]
    got = {r["run_id"]: (r["status"], r["bad"], r["pass_rate"], r["coverage"]) for r in history.run_stats(h).collect()}
    assert got == {"1": ("UNKNOWN", 1, 0.5, 0.5), "2": ("FAILED", None, None, None), "3": ("INTERRUPTED", None, None, None)}


def test_scope_hash():
    assert results.scope_hash("c", ["b", "a"]) == results.scope_hash("c", ["a", "b"]) != results.scope_hash("c", ["a"])
    assert results.scope_hash("c", []) == results.scope_hash("c", None)


def test_stream(spark, tmp_path):
    log, snap, ck = (str(tmp_path / x) for x in ("log", "snap", "ck"))

    def add(*rows):
        results.append_history(spark.createDataFrame(rows, "case_id string, run_id string, ts string, status string"), log)
        stream.follow(stream.history_stream(spark, log), snap, ck).awaitTermination()

    add(("a", "1", "2024-01-01", "failed"), ("b", "1", "2024-01-01", "ok"))
    add(("a", "2", "2024-01-02", "ok"), ("c", "2", "2024-01-02", "ok"), ("b", "0", "2023-01-01", "failed"))
    last = max(int(r["version"]) for r in spark.read.parquet(snap).select("version").distinct().collect())
    got = {r["case_id"]: r["status"] for r in spark.read.parquet(f"{snap}/version={last}").collect()}
    assert got == {"a": "ok", "b": "ok", "c": "ok"}
