"""Reports of a comparison: Markdown, JSON, text, JUnit XML.

Changes are listed, so they are taken to the driver; unchanged cases are counted only. JUnit names every case: the ids that pass
are streamed to it, a partition at a time.
"""

from __future__ import annotations

import io
import json
from dataclasses import dataclass
from typing import Any, TextIO
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.runs.compare import count_deltas, coverage_counts, diff_runs

TOP = 10


@dataclass(frozen=True)
class Comparison:
    changes: list[dict[str, Any]]
    counts: dict[str, dict[str, float | None]]
    coverage: dict[str, int]
    passing: DataFrame  # ids that didn't fail, not brought to the driver
    n_passing: int

    def of(self, outcome: str) -> list[dict[str, Any]]:
        return [c for c in self.changes if c["outcome"] == outcome]


def compare(base: DataFrame, new: DataFrame, fail_on: str = "bad", require_assert: bool = False) -> Comparison:
    diff = diff_runs(base, new, fail_on, require_assert)
    rows = [r.asDict() for r in diff.filter("outcome is not null").orderBy("id").collect()]
    passing = diff.filter("outcome is null or outcome = 'fixed'").select("id")
    counts = {r["metric"]: {k: r[k] for k in ("base", "new", "delta")} for r in count_deltas(base, new, fail_on, require_assert).collect()}
    return Comparison(rows, counts, coverage_counts(base, new).first().asDict(), passing, passing.count())


def _number(v: float | None, signed: bool = False) -> str:
    if v is None:
        return "n/a"
    text = f"{v:g}" if v == int(v) else f"{v:.2f}"
    return f"+{text}" if signed and v >= 0 else text


def markdown(c: Comparison) -> str:
    lines = ["# Run comparison", "", "## Summary", ""]
    lines += ["| metric | base | new | change |", "|---|---|---|---|"]
    lines += [f"| {m} | {_number(v['base'])} | {_number(v['new'])} | {_number(v['delta'], True)} |" for m, v in c.counts.items()]
    for title, outcome in (("New regressions", "new_fail"), ("Fixed", "fixed"), ("Still failing", "still_fail")):
        lines += ["", f"## {title}", ""]
        rows = c.of(outcome)
        lines += ["| id | status | reason |", "|---|---|---|", *[f"| {r['id']} | {r['from']} → {r['to']} | {r['reason']} |" for r in rows]] if rows else ["None"]
    return "\n".join(lines) + "\n"


def as_json(c: Comparison) -> str:
    top = lambda outcome: [{k: r[k] for k in ("id", "from", "to", "reason")} for r in c.of(outcome)[:TOP]]
    return json.dumps({"counts": c.counts, "coverage": c.coverage, "top_regressions": top("new_fail"), "top_fixes": top("fixed")}, ensure_ascii=False, indent=2)


def table(c: Comparison) -> str:
    lines = ["Summary:", *[f"  {m:<15} base={_number(v['base'])} new={_number(v['new'])} change={_number(v['delta'], True)}" for m, v in c.counts.items()], "Coverage:", "  " + " ".join(f"{k}={v}" for k, v in c.coverage.items())]
    for title, outcome in (("Top regressions:", "new_fail"), ("Top fixes:", "fixed")):
        lines += [title, *([f"  - {r['id']}: {r['from']} -> {r['to']} ({r['reason']})" for r in c.of(outcome)[:TOP]] or ["  none"])]
    return "\n".join(lines)


def write_junit(c: Comparison, to: TextIO, suite_name: str = "runs") -> None:
    """The failing cases in the order of their ids, then the passing ones; written as they come."""
    bad = sorted(c.of("new_fail") + c.of("still_fail"), key=lambda r: r["id"])
    to.write(f'<testsuite name={quoteattr(suite_name)} tests="{len(bad) + c.n_passing}" failures="{len(bad)}" errors="0">')
    for r in bad:
        to.write(f"<testcase name={quoteattr(r['id'])}><failure message={quoteattr(r['reason'] or f"{r['from']} → {r['to']}")} /></testcase>")
    for r in c.passing.orderBy("id").toLocalIterator():
        to.write(f"<testcase name={quoteattr(r['id'])} />")
    to.write("</testsuite>")


def junit(c: Comparison, suite_name: str = "runs") -> str:
    out = io.StringIO()
    write_junit(c, out, suite_name)
    return out.getvalue()


def top_changes(diff: DataFrame, outcome: str, n: int = TOP) -> DataFrame:
    return diff.filter(F.col("outcome") == outcome).orderBy("id").limit(n)
