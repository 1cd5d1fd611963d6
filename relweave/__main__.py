"""python -m relweave: selectors over files, questions to an agent, runs of cases and what became of them.

    query SCHEMA DATA SELECTOR [--format parquet] [--out DIR]   a JSON selector (or @file) over the entities' files below DATA
    describe SCHEMA DATA                                         what planners are told
    gen OUT [--rows 1000] [--seed 42]                            synthetic commerce tables as CSV, with their schema
    chat SCHEMA DATA                                             questions from standard input, one a line
    batch SCHEMA DATA CASES --runs FOLDER [--tag T]              ask cases and keep their results
    case SCHEMA DATA CASES ID --runs FOLDER                      ask one case
    open FOLDER ID [--run RUN]                                   a case's result in a run, the newest by default
    compare BASE NEW [--style table|markdown|json|junit]         two results files
    summary RESULTS [--by-tag]
    report FOLDER --tag T | --run RUN                            counts of a tag's newest results, or of a run
    tags FOLDER [--pattern P] [--sort updated|name]              tags with their last use
    history LOG [--last 10] [--by config_hash]                   newest runs of a log of runs
    stats FOLDER [--last 10]                                     the same of a folder
    case-history FOLDER ID [--tag T] [--last 20]                 a case's results, newest first

chat, batch and case ask the model that --config (a TOML file) or --model module:function names.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.plans.agent import Agent, CatalogProvider
from relweave.plans.compiler import Options, compile_request
from relweave.plans.shape import schema_text, serialize
from relweave.runs import history, report, results, summary
from relweave.runs.batch import Folder, run_batch
from relweave.runs.model import agent_of, load_settings, model_of
from relweave.semantic.build import build_semantic
from relweave.sources.catalog import Catalog, Schema
from relweave.sources.generate import SCHEMA, check_commerce, commerce, write_csv

RUNS = "run_id string, timestamp string, config_hash string, run_status string, pass_rate string, planned_total string, executed_total string, fail_count string, missed_total string, interrupted boolean, tag string"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="relweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options: dict) -> None:
        c = commands.add_parser(name)
        for x in positional:
            c.add_argument(x)
        for x, kw in options.items():
            c.add_argument("--" + x.replace("_", "-"), **kw)

    number, flag = (lambda n: {"type": int, "default": n}), {"action": "store_true"}
    policy = {"fail_on": {"default": "bad", "choices": ["error", "bad", "unchecked", "any", "skipped"]}, "require_assert": flag}
    agent = {"format": {"default": "parquet"}, "config": {}, "model": {}, "semantic": flag}
    command("query", "schema", "data", "selector", format={"default": "parquet"}, out={}, tolerance={"default": "none"})
    command("describe", "schema", "data", format={"default": "parquet"})
    command("gen", "out", rows=number(1000), seed=number(42))
    command("chat", "schema", "data", **agent)
    which = {x: {"type": lambda s: s.split(","), "default": None} for x in ("include_tags", "exclude_tags", "include_ids", "exclude_ids")}
    only = {"only_failed": flag, "only_missed": flag, "passes": number(2)}
    command("batch", "schema", "data", "cases", runs={"required": True}, tag={}, note={}, max_fails={"type": int}, plan_only=flag, **only, **which, **policy, **agent)
    command("case", "schema", "data", "cases", "id", runs={"required": True}, plan_only=flag, **policy, **agent)
    command("open", "folder", "id", run={})
    command("compare", "base", "new", style={"default": "table", "choices": ["table", "markdown", "json", "junit"]}, out={}, **policy)
    command("summary", "results", by_tag=flag)
    command("report", "folder", tag={}, run={}, **policy)
    command("tags", "folder", pattern={}, sort={"default": "updated", "choices": ["updated", "name"]}, limit={"type": int})
    command("history", "log", last=number(10), by={})
    command("stats", "folder", last=number(10), by={})
    command("case-history", "folder", "id", tag={}, last=number(20))
    return p


def _print(df: DataFrame) -> None:
    """Rows as JSON lines; only of frames with few rows."""
    for row in df.collect():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))


def _agent(spark: SparkSession, a: argparse.Namespace) -> Agent:
    catalog = Catalog.from_schema(spark, Schema.load(a.schema), a.format, data_dir=a.data)
    if a.semantic:
        catalog.semantic = build_semantic(catalog)
    settings = load_settings(a.config)
    return agent_of(model_of(settings, a.model), {"catalog": CatalogProvider("catalog", catalog, count_rest=False)}, settings)


def _ask(agent: Agent, plan_only: bool):
    if not plan_only:
        return lambda question: str(agent.run(question))

    def plan(question: str) -> None:
        agent.plan_parser(str(agent.plan(question, {})))

    return plan


def _chosen(folder: Folder, cases: DataFrame, a: argparse.Namespace) -> DataFrame:
    """The cases that are to be asked: by tags and ids, then what the newest results say of them."""
    own = history.select_cases(cases, a.include_tags, a.exclude_tags, a.include_ids, a.exclude_ids)
    if not (a.only_failed or a.only_missed):
        return own
    base = folder.snapshot(a.tag) if a.tag else folder.latest()
    if base is None:
        raise SystemExit("there are no results yet to choose by")
    if a.only_missed:
        return own.join(history.only_missed(own, base, None), "id", "left_semi")
    passed = history.healed(history.newest_per_run(folder.cases(), a.tag), a.passes, a.fail_on, a.require_assert)
    return own.join(history.only_failed(base, base, passed, a.fail_on, a.require_assert), "id", "left_semi")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("relweave").getOrCreate()
    return COMMANDS[a.command](spark, a)


def _query_command(spark: SparkSession, a: argparse.Namespace) -> int:
    catalog = Catalog.from_schema(spark, Schema.load(a.schema), a.format, data_dir=a.data)
    text = Path(a.selector[1:]).read_text(encoding="utf-8") if a.selector.startswith("@") else a.selector
    result = compile_request(catalog, json.loads(text), Options(tolerance=a.tolerance))
    if a.out:
        result.frame.write.mode("errorifexists").parquet(a.out)
    else:
        s = catalog.schema
        print(serialize(result, schema_text([e.name for e in s.entities], [r.name for r in s.relations])))
    return 0


def _describe_command(spark: SparkSession, a: argparse.Namespace) -> int:
    print(CatalogProvider("catalog", Catalog.from_schema(spark, Schema.load(a.schema), a.format, data_dir=a.data)).describe().description)
    return 0


def _gen_command(spark: SparkSession, a: argparse.Namespace) -> int:
    tables = commerce(spark, a.rows, a.seed)
    check_commerce(tables, a.rows)
    write_csv(tables, a.out)
    Schema.parse(SCHEMA).save(f"{a.out}/schema.json")
    return 0


def _chat_command(spark: SparkSession, a: argparse.Namespace) -> int:
    agent = _agent(spark, a)
    for line in sys.stdin:
        if (question := line.strip()) in ("exit", "quit"):
            break
        if question:
            try:
                print(agent.run(question), flush=True)
            except Exception as e:  # noqa: BLE001 - the next question may do better
                print(f"{type(e).__name__}: {e}", flush=True)
    return 0


def _batch_command(spark: SparkSession, a: argparse.Namespace) -> int:
    folder, source = Folder(spark, a.runs), results.read_cases(spark, a.cases)
    config = results.scope_hash(json.dumps(load_settings(a.config), sort_keys=True))
    scope = results.scope_hash(a.cases, a.include_tags, a.exclude_tags, a.include_ids, a.exclude_ids)
    run, entry = run_batch(
        folder, _chosen(folder, source, a), _ask(_agent(spark, a), a.plan_only), tag=a.tag, note=a.note, fail_on=a.fail_on, require_assert=a.require_assert, max_fails=a.max_fails, plan_only=a.plan_only, scope=scope, config=config
    )
    print(json.dumps(entry, ensure_ascii=False))
    return 130 if entry["interrupted"] else int(bool(entry["fail_count"]))


def _case_command(spark: SparkSession, a: argparse.Namespace) -> int:
    folder, own = Folder(spark, a.runs), results.read_cases(spark, a.cases).filter(F.col("id") == a.id)
    if own.isEmpty():
        raise SystemExit(f"there is no case {a.id!r}")
    run, entry = run_batch(folder, own, _ask(_agent(spark, a), a.plan_only), fail_on=a.fail_on, require_assert=a.require_assert, plan_only=a.plan_only)
    _print(folder.results(run))
    return int(bool(entry["fail_count"]))


def _open_command(spark: SparkSession, a: argparse.Namespace) -> int:
    folder = Folder(spark, a.folder)
    found = folder.results(a.run) if a.run else folder.latest()
    if found is None or (own := found.filter(F.col("id") == a.id)).isEmpty():
        raise SystemExit(f"there is no result of case {a.id!r}")
    _print(own)
    return 0


def _compare_command(spark: SparkSession, a: argparse.Namespace) -> int:
    c = report.compare(results.read_results(spark, a.base), results.read_results(spark, a.new), a.fail_on, a.require_assert)
    if a.style == "junit":
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                report.write_junit(c, f)
        else:
            report.write_junit(c, sys.stdout)
            print()
    else:
        text = {"table": report.table, "markdown": report.markdown, "json": report.as_json}[a.style](c)
        Path(a.out).write_text(text, encoding="utf-8") if a.out else print(text)
    return int(bool(c.of("new_fail")))


def _summary_command(spark: SparkSession, a: argparse.Namespace) -> int:
    r = results.read_results(spark, a.results)
    _print(summary.by_tag(r).orderBy("tag") if a.by_tag else summary.summarize(r))
    return 0


def _report_command(spark: SparkSession, a: argparse.Namespace) -> int:
    folder = Folder(spark, a.folder)
    found = folder.snapshot(a.tag) if a.tag else folder.results(a.run) if a.run else folder.latest()
    if found is None:
        raise SystemExit("there are no results")
    _print(summary.summarize(found))
    _print(summary.worst_tags(found, fail_on=a.fail_on, require_assert=a.require_assert))
    return int(bool(summary.bad_count(found, a.fail_on, a.require_assert).first()["bad"]))


def _tags_command(spark: SparkSession, a: argparse.Namespace) -> int:
    _print(summary.tag_list(Folder(spark, a.folder).cases(), a.pattern, a.sort, a.limit))
    return 0


def _history_command(spark: SparkSession, a: argparse.Namespace) -> int:
    _print(history.run_stats(history.last_runs(results.read_history(spark, a.log, RUNS), a.last, a.by)))
    return 0


def _stats_command(spark: SparkSession, a: argparse.Namespace) -> int:
    _print(history.run_stats(history.last_runs(Folder(spark, a.folder).runs(), a.last, a.by)))
    return 0


def _case_history_command(spark: SparkSession, a: argparse.Namespace) -> int:
    own = history.newest_per_run(Folder(spark, a.folder).cases().filter(F.col("case_id") == a.id), a.tag)
    _print(own.filter(F.col("recency") <= a.last).orderBy("recency").select("run_id", "ts", "tag", "status", "reason", "duration_ms"))
    return 0


COMMANDS = {
    "query": _query_command,
    "describe": _describe_command,
    "gen": _gen_command,
    "chat": _chat_command,
    "batch": _batch_command,
    "case": _case_command,
    "open": _open_command,
    "compare": _compare_command,
    "summary": _summary_command,
    "report": _report_command,
    "tags": _tags_command,
    "history": _history_command,
    "stats": _stats_command,
    "case-history": _case_history_command,
}

if __name__ == "__main__":
    raise SystemExit(main())
