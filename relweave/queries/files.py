"""Registered queries over what is written and read again: sources of all kinds, indexes, result, case and history files, reports, streams, plans."""

from __future__ import annotations

import json
import math
import os
import shutil
import uuid
import zipfile
from collections import Counter
from xml.etree import ElementTree

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.functions.json_repair import repaired
from relweave.functions.text import case_status, truncate_tokens
from relweave.plans.agent import Agent, Baseline, CatalogProvider, Fetch, Packer, parse_json, parse_plan
from relweave.plans.compiler import Options, compile_request, execute
from relweave.plans.describe import selector_schema
from relweave.plans.materialize import scratch
from relweave.plans.partitioning import spread
from relweave.plans.scope import quoted
from relweave.plans.shape import serialize
from relweave.queries import relational, runs
from relweave.queries.schemas import SHOP, SUPPLY, catalog
from relweave.runs import history, report, results, summary
from relweave.semantic.build import build_semantic
from relweave.semantic.dense import Dense, Store
from relweave.semantic.dense import top_k as dense_top_k
from relweave.semantic.tfidf import read_json_index
from relweave.sources.catalog import Catalog, Schema
from relweave.sources.generate import fingerprint_distributed, save_tables, write_csv
from relweave.streaming import history as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _only(*names: str, **sources: str) -> Schema:
    """The supply schema of some tables, with other sources."""
    own = [{**e, "source": sources.get(e["name"], e["source"])} for e in SUPPLY["entities"] if e["name"] in names]
    return Schema.parse({"name": "+".join(names), "entities": own, "relations": [r for r in SUPPLY["relations"] if {r["from_entity"], r["to_entity"]} <= set(names)]})


def _columns(table: str) -> str:
    return relational.names(SUPPLY, table, table)


# --- sources ----------------------------------------------------------------------------------------------------


@query(f"select {_columns('customer')} from customer")
def source_csv(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "csv")
    write_csv({"customer": _read(spark, sf, "customer")}, folder)
    c = Catalog.from_schema(spark, _only("customer", customer="customer.csv"), "csv", data_dir=folder)
    return execute(c, {"op": "query", "root_entity": "customer", "limit": None})


@query("select p_type, count(*) as count from part where p_size > 20 group by 1")
def source_json(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "json")
    _read(spark, sf, "part").write.json(f"{folder}/part.json")
    c = Catalog.from_schema(spark, _only("part", part="part.json"), "json", data_dir=folder)
    return execute(c, {"op": "query", "root_entity": "part", "limit": None, "filters": relational.where("p_size", ">", 20), "group_by": [{"field": "p_type"}]})


@query(f"select {_columns('supplier')} from supplier where s_acctbal < 0")
def source_orc(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "orc")
    _read(spark, sf, "supplier").write.orc(f"{folder}/supplier.orc")
    c = Catalog.from_schema(spark, _only("supplier", supplier="supplier.orc"), "orc", data_dir=folder)
    return execute(c, {"op": "query", "root_entity": "supplier", "limit": None, "filters": relational.where("s_acctbal", "<", 0)})


_NATIONS = 'select n_name, r_name as "region__r_name" from nation left join region on n_regionkey = r_regionkey'
_NATION_REQUEST = {"op": "query", "root_entity": "nation", "relations": ["nation_region"], "limit": None, "select": [{"expr": "n_name"}, {"expr": "region.r_name"}]}


@query(_NATIONS)
def source_frames(spark: SparkSession, sf: str) -> DataFrame:
    frames = {t: _read(spark, sf, t) for t in ("nation", "region")}
    return execute(Catalog.from_frames(spark, _only("nation", "region"), frames), _NATION_REQUEST)


@query(_NATIONS)
def source_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Saved as tables of a database and found by a resolver, the schema's name and the source's stem."""
    database = f"relweave_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch(spark, 'tables')}'")
    save_tables({"nation_copy": _read(spark, sf, "nation"), "region": _read(spark, sf, "region")}, database)
    c = Catalog.from_schema(spark, _only("nation", "region"), "table", default_schema=database, table_name_resolver=lambda e: "nation_copy" if e.name == "nation" else None)
    return execute(c, _NATION_REQUEST)


def derby(spark: SparkSession, tables: dict[str, DataFrame]) -> str:
    """The URL of a read-only Derby database that holds the tables, in an archive below the shared folder.

    One in memory is only there in the JVM that made it, and one in a folder is locked by the JVM that opened it first; from an archive, the driver and all executors
    read at once. The rows are written as text by all tasks, and imported from there, file by file, by the driver. The archive isn't compressed, so a page is found without reading those before it.
    Columns may be text, numbers (Derby refuses NaN), truth values and dates.
    """
    folder = scratch(spark, "derby")
    if not folder.startswith(("file:/", "/")):
        raise RuntimeError("Derby can't read from a shared folder that isn't mounted")
    folder = "/" + folder.removeprefix("file:").lstrip("/")
    os.makedirs(folder)
    url = f"jdbc:derby:{folder}/db"
    connect = spark._jvm.java.sql.DriverManager.getConnection
    for name, df in tables.items():
        fields = [F.concat(F.lit('"'), F.replace(F.col(quoted(c)).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
        df.select(F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields])).write.text(f"file://{folder}/{name}")  # a null is an empty field without quotes
        df.limit(0).write.jdbc(f"{url};create=true", name)  # the driver makes the table; without rows there is no task
        to = connect(url)
        for f in sorted(os.listdir(f"{folder}/{name}")):
            if f.startswith("part-") and os.path.getsize(f"{folder}/{name}/{f}"):
                call = to.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
                call.setString(1, name.upper())
                call.setString(2, f"{folder}/{name}/{f}")
                call.execute()
        to.close()
        shutil.rmtree(f"{folder}/{name}")
    try:
        connect(f"{url};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # which says that it is closed
            raise
    with zipfile.ZipFile(f"{folder}/db.jar", "w", zipfile.ZIP_STORED) as z:
        for at, _, names in os.walk(f"{folder}/db"):
            for n in names:
                z.write(f"{at}/{n}", os.path.relpath(f"{at}/{n}", folder))
    shutil.rmtree(f"{folder}/db")
    return f"jdbc:derby:jar:({folder}/db.jar)db"


@query('select o_orderkey, c_name as "customer__c_name" from orders left join customer on o_custkey = c_custkey where o_totalprice > 400000')
def source_jdbc(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in a database, read over several connections; the orders' distinct keys are sent along where they are few."""
    options = {"url": derby(spark, {"customer": _read(spark, sf, "customer")})}
    remote = Catalog.from_schema(spark, _only("customer", customer="customer"), "jdbc", options=options, partitions=4)
    local = Catalog.from_schema(spark, Schema.parse({**SUPPLY, "name": "files", "entities": [e for e in SUPPLY["entities"] if e["name"] == "orders"], "relations": [r for r in SUPPLY["relations"] if r["name"] == "orders_customer"]}), "parquet", data_dir=sf)
    request = {"op": "query", "root_entity": "orders", "relations": ["orders_customer"], "limit": None, "filters": relational.where("o_totalprice", ">", 400000), "select": [{"expr": "o_orderkey"}, {"expr": "customer.c_name"}]}
    return execute(Catalog.merge({"files": local, "database": remote}), request, Options(push_keys=50_000))


@query("select n_name as name, n_regionkey as region from nation where n_regionkey = 2")
def source_backend(spark: SparkSession, sf: str) -> DataFrame:
    """A backend that answers queries in a way of its own."""
    c = Catalog(spark, _only("nation"), handlers={"query": lambda request: _read(spark, sf, request.root_entity).filter(F.col(request.filters.field) == request.filters.value).select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))})
    return execute(c, {"op": "query", "root_entity": "nation", "filters": relational.where("n_regionkey", "=", 2)})


_TYPES = "case when data_type like '%INT%' then 'int' when data_type = 'VARCHAR' then 'text' when data_type in ('DOUBLE', 'FLOAT') then 'float' when data_type like 'TIMESTAMP%' then 'timestamp' else lower(data_type) end"


@query(f"select table_name as entity, column_name as \"column\", {_TYPES} as type from information_schema.columns where table_name in ('region', 'nation', 'customer', 'supplier', 'part')")
def schema_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A dumped and parsed schema against the tables' own columns."""
    kept = ("region", "nation", "customer", "supplier", "part")
    again = Schema.parse(json.loads(json.dumps(_only(*kept).dump())))
    declared = Catalog.from_schema(spark, again, "parquet", data_dir=sf)
    assert not again.problems() and all(set(declared.columns(t)) == set(declared.table(t).columns) for t in kept)
    return declared.entities_frame().select("entity", "column", "type")


@query("select true as same_again, true as other_after_a_change, (select count(*) from region) as n_rows")
def folder_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "print")
    _read(spark, sf, "region").coalesce(1).write.mode("append").csv(folder)
    one, two = (fingerprint_distributed(spark, folder).first() for _ in range(2))
    _read(spark, sf, "nation").coalesce(1).write.mode("append").json(folder)
    three = fingerprint_distributed(spark, folder).first()
    n = _read(spark, sf, "region").count()
    return spark.createDataFrame([(one == two, one["hash"] != three["hash"] and three["files_count"] == one["files_count"] + 1 and three["bytes_total"] > one["bytes_total"], n)], "same_again boolean, other_after_a_change boolean, n_rows long")


# --- indexes ----------------------------------------------------------------------------------------------------


@query(relational.SQL["tfidf_search"])
def index_written(spark: SparkSession, sf: str) -> DataFrame:
    """Built and written once, then found and read again."""
    c, folder = catalog(spark, sf), scratch(spark, "index")
    build_semantic(c, folder, only=["part"])
    c.semantic = build_semantic(c, folder, only=["part"])
    return execute(c, {"op": "semantic_only", "entity": "part", "fields": [], "query": "red gizmo economy", "top_k": 50}).select("id", F.round("score", 9).alias("score"))


@query(f"{relational._tfidf('nation', 'n_nationkey', ('n_name',), 'nation_3 NATION_7')} select id, round(score, 9) as score from ({relational._scores(chr(39) + '__all__' + chr(39), 10)})")
def index_legacy(spark: SparkSession, sf: str) -> DataFrame:
    """The older form, one JSON file, with rows of both kinds."""
    rows = _read(spark, sf, "nation").select("n_nationkey", F.lower("n_name")).collect()
    df = Counter(name for _, name in rows)
    vocab = sorted(df)
    unit = lambda name: [float(w == name) for w in vocab]
    items = [{"id": k, "vector": unit(name)} if i % 2 else {"id": k, "vectors": {"vector": unit(name), "n_name": unit(name)}} for i, (k, name) in enumerate(rows)]
    data = {"entity": "nation", "fields": ["n_name"], "vocab": vocab, "idf": [math.log((1 + len(rows)) / (1 + df[w])) + 1 for w in vocab], "embeddings": items}
    folder = scratch(spark, "legacy")
    spark.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.text(folder)
    return read_json_index(spark, folder, "nation", "long").search("nation", [], "nation_3 NATION_7", 10).select("id", F.round("score", 9).alias("score"))


class Letters:
    """A model of text by how often it has each of a few letters."""

    letters = "aeior"

    def embed_query(self, text: str) -> list[float]:
        return [float(text.lower().count(c)) for c in self.letters]

    def embed_documents(self, texts) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


def _letters(text: str) -> str:
    return "[" + ", ".join(f"cast(length({text}) - length(replace(lower({text}), '{c}', '')) as double)" for c in Letters.letters) + "]"


@query(
    f"""with t as (select p_partkey id, {_letters("p_name || ' ' || p_type")} v, {_letters("'green rotor'")} q from part),
 s as (select id, coalesce(list_dot_product(v, q) / nullif(sqrt(list_dot_product(v, v)), 0) / sqrt(list_dot_product(q, q)), 0) s from t)
 select id, round(s, 9) as score from s order by round(s, 12) desc, id limit 40"""
)
def dense_text_search(spark: SparkSession, sf: str) -> DataFrame:
    index = Dense.build(_read(spark, sf, "part"), "part", "p_partkey", ["p_name", "p_type"], Letters())
    return index.search("part", [], "green rotor", 40).select("id", F.round("score", 9).alias("score"))


@query(
    """with t as (select vec_id, embedding[4]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])) s from embeddings order by round(s, 12) desc, vec_id limit 30)
 select cast(vec_id as varchar) as id, round(1 / (1 + (1 - s)), 6) as score from t"""
)
def store_by_vector(spark: SparkSession, sf: str) -> DataFrame:
    """A store that is asked by the vector a model gives."""
    vectors = _read(spark, sf, "embeddings")
    size = len(vectors.first()["embedding"])

    class Axis:
        def embed_query(self, text: str) -> list[float]:
            return [float(i == int(text)) for i in range(size)]

    def fetch(vector: list[float], k: int) -> DataFrame:
        found = dense_top_k(vectors, vector, k, "vec_id", "embedding")
        return found.select(F.create_map(F.lit("entity"), F.lit("embeddings"), F.lit("id"), F.col("id").cast("string")).alias("metadata"), (1 - F.col("score")).alias("value"))

    return Store(spark, model=Axis(), fetch_by_vector=fetch).search("embeddings", [], "3", 30).select("id", F.round("score", 6).alias("score"))


@query("select cast(doc_id as varchar) as id, align_score as score from documents where contains(text, 'the') and align_score is not null and doc_id % 3 <> 0 and lang in ('en', 'de') order by align_score desc, id limit 25")
def store_by_text(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of other entities and fields are left aside; similarities stay as they are."""

    def fetch(text: str, k: int) -> DataFrame:
        own = _read(spark, sf, "documents").filter(F.contains("text", F.lit(text)) & F.col("align_score").isNotNull())
        meta = F.create_map(F.lit("entity"), F.when(F.col("doc_id") % 3 == 0, "other").otherwise("documents"), F.lit("field"), F.col("lang"), F.lit("pk"), F.col("doc_id").cast("string"))
        return own.filter("lang is not null").select(meta.alias("metadata"), F.col("align_score").alias("value"))

    return Store(spark, fetch, score_kind="similarity").search("documents", ["en", "de"], "the", 25)


# --- results, cases, histories ----------------------------------------------------------------------------------


def _text_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.col("id").cast("string"))


@query(runs._R + "select cast(id as varchar) as id, status, status <> 'unchecked' as checked, cast(floor(value * 1000) as bigint) as duration_ms, case when id % 2 = 0 then 2 else 1 end as n_tags from base")
def results_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "results")
    results.write_results(_text_ids(runs._two(spark, sf)[0]), path)
    return results.read_results(spark, path).select("id", "status", "checked", "duration_ms", F.size("tags").alias("n_tags"))


@query(runs.SQL["runs_newest_per_run"])
def history_file(spark: SparkSession, sf: str) -> DataFrame:
    """A log that was appended to twice, with a line that can't be read."""
    path, entries = scratch(spark, "history"), runs._entries(spark, sf)
    for part in (0, 1):
        results.append_history(entries.filter(F.col("run_id").cast("int") % 2 == part), path)
    spark.createDataFrame([('{"case_id": "1", "run_id',)], "value string").coalesce(1).write.mode("append").text(path)
    return history.newest_per_run(results.read_history(spark, path)).select("case_id", "run_id", "status", F.col("recency").cast("long").alias("recency"))


@query(runs._H + "select case_id, run_id, status from (select * from hn where recency = 1)")
def history_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot that a stream keeps of a log which grows between two runs of it."""
    log, snapshot, state = (scratch(spark, x) for x in ("log", "snapshot", "state"))
    entries = history.newest_per_run(runs._entries(spark, sf)).select("case_id", "run_id", "ts", "status")
    for part in (0, 1):
        results.append_history(entries.filter(F.col("run_id").cast("int") % 2 == part), log)
        stream.follow(stream.history_stream(spark, log), snapshot, state).awaitTermination()
    return spark.read.parquet(f"{snapshot}/version=1").select("case_id", "run_id", "status")


@query("select cast(c_custkey as varchar) as id, 'Segment of ' || c_name || '?' as question, c_mktsegment as expected, case when c_acctbal < 0 then 1 else 0 end as n_tags, c_custkey % 10 = 0 as skip from customer")
def cases_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "cases")
    c = _read(spark, sf, "customer")
    c.select(
        F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("Segment of "), "c_name", F.lit("?")).alias("question"), F.col("c_mktsegment").alias("expected"),
        F.when(F.col("c_acctbal") < 0, F.array(F.lit("debt"))).alias("tags"), F.when(F.col("c_custkey") % 10 == 0, True).alias("skip"),
    ).write.json(path)
    return results.read_cases(spark, path).select("id", "question", "expected", F.size("tags").alias("n_tags"), "skip")


_CHANGES = runs._R + runs._DIFF.format(bad=runs._BAD)


def _comparison(spark: SparkSession, sf: str) -> report.Comparison:
    return report.compare(*map(_text_ids, runs._two(spark, sf)))


@query(f'select cast(id as varchar) as id, "from", "to", reason from ({_CHANGES}) where outcome = \'new_fail\'')
def report_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """The table of new regressions, read back from the report."""
    section = report.markdown(_comparison(spark, sf)).split("## New regressions")[1].split("##")[0]
    rows = [[c.strip() for c in line.strip("|").split("|")] for line in section.splitlines() if line.startswith("| ") and not line.startswith("| id |")]
    return spark.createDataFrame([(i, *[None if s == "None" else s for s in change.split(" → ")], reason) for i, change, reason in rows], "id string, `from` string, `to` string, reason string")


@query(f"select '  - ' || id || ': ' || coalesce(\"from\", 'None') || ' -> ' || \"to\" || ' (' || reason || ')' as line from (select cast(id as varchar) as id, \"from\", \"to\", reason from ({_CHANGES}) where outcome = 'new_fail') order by id limit 10")
def report_table(spark: SparkSession, sf: str) -> DataFrame:
    text = report.table(_comparison(spark, sf)).split("Top regressions:\n")[1].split("\nTop fixes:")[0]
    return spark.createDataFrame([(line,) for line in text.splitlines()], "line string")


@query(f"select cast(id as varchar) as id, coalesce(outcome in ('new_fail', 'still_fail'), false) as failed from ({_CHANGES})")
def report_junit(spark: SparkSession, sf: str) -> DataFrame:
    suite = ElementTree.fromstring(report.junit(_comparison(spark, sf)))
    return spark.createDataFrame([(c.get("name"), c.find("failure") is not None) for c in suite], "id string, failed boolean")


@query(
    f"""with x as (select id, "from", "to" from ({_CHANGES}) where outcome = 'new_fail' or outcome = 'fixed')
 select 'regressions' as what, cast(count(*) filter ("to" in ({runs._BAD}, 'missing')) as bigint) as n from x union all select 'fixes', count(*) filter ("to" not in ({runs._BAD}, 'missing')) from x"""
)
def report_json(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of the report in JSON, counted; its own lists are cut to the first few, so the whole lists are compared with these."""
    c = _comparison(spark, sf)
    shown = json.loads(report.as_json(c))
    assert shown["top_regressions"] == [{k: r[k] for k in ("id", "from", "to", "reason")} for r in c.of("new_fail")[: report.TOP]]
    return spark.createDataFrame([("regressions", len(c.of("new_fail"))), ("fixes", len(c.of("fixed")))], "what string, n long")


@query("select event_type as tag, max(epoch(date_trunc('second', ts))) as updated, count(distinct event_id % 7) as n_runs, count(distinct event_id % 500) as n_cases from events where regexp_matches(event_type, '^.*i.*$') group by 1 order by 2 desc, 1 limit 3")
def tags_by_update(spark: SparkSession, sf: str) -> DataFrame:
    entries = runs._entries(spark, sf).drop("tag")
    kinds = _read(spark, sf, "events").select((F.col("event_id") % 500).cast("string").alias("case_id"), (F.col("event_id") % 7).cast("string").alias("run_id"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("ts"), F.col("event_type").alias("tag"))
    assert set(kinds.columns) <= {*entries.columns, "tag"}
    return summary.tag_list(kinds, "*i*", limit=3)


@query(
    " union all ".join(
        f"select '{name}' as selection, sha256('{text}') as hash"
        for name, text in (
            ("all", '{"cases_hash": "c1", "exclude_ids": null, "exclude_tags": null, "include_ids": null, "include_tags": null}'),
            ("tags", '{"cases_hash": "c1", "exclude_ids": null, "exclude_tags": ["x"], "include_ids": null, "include_tags": ["a", "b"]}'),
            ("ids", '{"cases_hash": "c2", "exclude_ids": ["9"], "exclude_tags": null, "include_ids": ["1", "2"], "include_tags": null}'),
        )
    )
)
def scope_hashes(spark: SparkSession, sf: str) -> DataFrame:
    given = {"all": results.scope_hash("c1", [], None), "tags": results.scope_hash("c1", ["b", "a"], ["x"]), "ids": results.scope_hash("c2", include_ids=["2", "1"], exclude_ids=["9"])}
    return spark.createDataFrame(list(given.items()), "selection string, hash string")


@query("select event_id, case when event_type = 'error' then 'error' when event_id % 3 = 0 then 'ok' when event_id % 3 = 1 then 'mismatch' when event_id % 2 = 0 then 'plan_only' else 'unchecked' end as status from events")
def case_statuses(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    error = F.when(F.col("event_type") == "error", "failed").when(n % 5 == 0, "")
    passed = F.when(n % 3 == 0, True).when(n % 3 == 1, False)
    return _read(spark, sf, "events").select("event_id", case_status(error, passed, n % 2 == 0).alias("status"))


@query("select doc_id, md5(substring(text, 1, 80)) as head from documents where text is not null")
def token_truncation(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").filter("text is not null").select("doc_id", F.md5(truncate_tokens(F.col("text"), 20)).alias("head"))


# --- plans and texts --------------------------------------------------------------------------------------------

#: How a model's answer can wrap or damage ``{"k": 87}``.
DAMAGES = {
    "think": ('<think>or {"k": -1}?</think> ', "{0}", ""),
    "prose with a list": ("As said in [the note] before: ", "{0}", " and so on"),
    "block comment": ("", '{{/* the key */ "k": {1} // its value\n}}', ""),
    "ellipsis": ("", '{{"k": {1}, ...}}', ""),
    "escaped": ("", '{{\\"k\\": {1}}}', ""),
    "in a string": ('"', '{{\\"k\\": {1}}}', '"'),
    "unicode escape": ("", '{{"\\u006b": {1}}}', ""),
    "curly quotes": ("", "{{“k”: {1}}}", ""),
    "mark and white space": ("﻿ \t", '{{"k":\r\n\t{1}}}', " \x0b"),
    "wrong bracket": ("", '{{"k": {1}]', ""),
    "two fences": ("```\nno json\n```\n```json\n", "{0}", "\n```"),
}


@query(" union all ".join(f"select '{name}' as damage, count(*) as n, count(*) as same from events where props is not null and event_id % {len(DAMAGES)} = {i}" for i, name in enumerate(DAMAGES)))
def json_damages(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties in every damage read as the undamaged ones do."""
    e = _read(spark, sf, "events").filter("props is not null").withColumn("v", F.regexp_extract("props", r"(-?[0-9.]+)", 1))
    n, damage, text = F.col("event_id") % len(DAMAGES), F, F
    for i, (name, (before, form, after)) in enumerate(DAMAGES.items()):
        pieces = form.format("\0", "\1")
        parts = [F.col("props") if p == "\0" else F.col("v") if p == "\1" else F.lit(p) for p in pieces.replace("\0", "\2\0\2").replace("\1", "\2\1\2").split("\2") if p]
        damage, text = damage.when(n == i, name), text.when(n == i, F.concat(F.lit(before), *parts, F.lit(after)))
    both = spread(e.select(damage.alias("damage"), text.alias("d"), "props")).select("damage", repaired("d").alias("a"), repaired("props").alias("b"))
    return both.groupBy("damage").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


_ANSWER = """Here is the plan:
```json
{'required_context': ['supply'], // sources
 "context_plan": [{"provider": "supply", "mode": "slice", "selectors": {"op": "schema"}, "max_tokens": 50}, {"provider": 3}, {"provider": "notes", "max_tokens": "many"}, {"provider": "notes"},],
 "entities": [{"name": "order", "change": "UPDATE", "fields": [{"name": "total", "change": "odd"}]}]}
```"""


@query("select * from (values ('fetch', 'supply', 'slice', 50), ('fetch', 'notes', 'full', null), ('required', 'supply', null, null), ('entity', 'order', 'update', null), ('field', 'total', 'new', null), ('key', 'context_plan', null, 4)) t(kind, name, mode, n)")
def plan_parsed(spark: SparkSession, sf: str) -> DataFrame:
    plan = parse_plan(_ANSWER)
    rows = [("fetch", f.provider, f.mode, f.max_tokens) for f in plan.context_plan] + [("required", r, None, None) for r in plan.required_context]
    rows += [("entity", e["name"], e["change"], None) for e in plan.entities] + [("field", f["name"], f["change"], None) for e in plan.entities for f in e["fields"]]
    rows += [("key", k, None, len(v)) for k, v in parse_json(_ANSWER, "context_plan").items()]
    return spark.createDataFrame(rows, "kind string, name string, mode string, n int")


_SUPPLY_LINE = "select 'o_orderstatus=' || o_orderstatus || ' | n=' || count(*) as line from orders group by o_orderstatus"


@query(f"select 'supply' as source, line from ({_SUPPLY_LINE}) union all select 'supply#2', 'Aggregations: n=' || count(*) from customer union all select 'regions', 'r_name=' || r_name from region")
def agent_context(spark: SparkSession, sf: str) -> DataFrame:
    """What an agent's answer is made from: a planned fetch, a baseline of another source, a refetch, and a draft that a verifier sends back."""
    c = catalog(spark, sf)
    status = {"op": "query", "root_entity": "orders", "group_by": [{"field": "o_orderstatus"}], "aggregations": [{"field": "o_orderkey", "agg": "count", "alias": "n"}]}
    buyers = {"op": "query", "root_entity": "customer", "aggregations": [{"field": "c_custkey", "agg": "count", "alias": "n"}]}
    saved: list = []

    class NotEmpty:
        name = "not empty"

        def check(self, draft: str) -> list[str]:
            return [] if json.loads(draft) else ["says nothing"]

    agent = Agent(
        plan=lambda feature, context: "```json\n" + json.dumps({"context_plan": [{"provider": "supply", "selectors": status}]}) + "\n```",
        synth=lambda feature, context, plan: {"text": json.dumps({k: v for k, v in context.items() if k != "issues"} if "issues" in context else {})},
        providers={"supply": CatalogProvider("supply", c), "regions": CatalogProvider("regions", c)},
        packer=Packer(10_000, lambda text: text[:10]),
        parse=json.loads,
        save=lambda feature, parsed: saved.append(parsed),
        verifiers=(NotEmpty(),),
        baseline=(Baseline(Fetch("regions", selectors={"op": "query", "root_entity": "region", "select": [{"expr": "r_name"}]})),),
        refetch=lambda feature, context, plan: json.dumps({"stop": False, "add_specs": [{"provider": "supply", "selectors": buyers}]}),
    )
    parsed = agent.run("how are the orders?")
    assert saved == [parsed] and not agent.open_findings
    return spark.createDataFrame([(k, line) for k, text in parsed.items() for line in text.splitlines()], "source string, line string")


@query("select 'table' as kind, table_name as name from information_schema.tables where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events') union all select 'relation', unnest(['orders_customer', 'orders_customer_inner', 'lineitem_orders', 'lineitem_part', 'lineitem_supplier', 'customer_nation', 'supplier_nation', 'nation_region', 'nation_peer', 'customer_events'])")
def described_names(spark: SparkSession, sf: str) -> DataFrame:
    """The names that the JSON Schema of requests allows."""
    form = selector_schema(catalog(spark, sf))["oneOf"][2]["properties"]
    return spark.createDataFrame([("table", n) for n in form["root_entity"]["enum"]] + [("relation", n) for n in form["relations"]["items"]["enum"]], "kind string, name string")


@query("select 'r_regionkey=' || r_regionkey || ' | r_name=' || r_name as line from region")
def serialized_rows(spark: SparkSession, sf: str) -> DataFrame:
    text = serialize(compile_request(catalog(spark, sf), {"op": "query", "root_entity": "region", "limit": None}))
    return spark.createDataFrame([(line,) for line in text.splitlines()], "line string")


#: Requests that are refused, and how.
REFUSED = {
    "ambiguous": ("ValueError", "Ambiguous reference 'nation'", {"root_entity": "lineitem", "relations": ["lineitem_orders", "orders_customer", "lineitem_supplier", "customer_nation", "supplier_nation"], "select": [{"expr": "nation.n_name"}]}),
    "unreachable": ("ValueError", "Neither entity of relation 'nation_region'", {"root_entity": "orders", "relations": ["nation_region"]}),
    "twice": ("ValueError", "Duplicate relation key 'orders_customer'", {"root_entity": "orders", "relations": ["orders_customer", "orders_customer"]}),
    "no relation": ("KeyError", "Relation 'nowhere' not found", {"root_entity": "orders", "relations": ["nowhere"]}),
    "no column": ("KeyError", "Column 'x' not found in 'orders'", {"root_entity": "orders", "select": [{"expr": "x"}]}),
    "text for in": ("TypeError", "'in' and 'not_in' take a list", {"root_entity": "orders", "filters": relational.where("o_orderstatus", "in", "F")}),
    "list for =": ("TypeError", "'=' takes a single value", {"root_entity": "orders", "filters": relational.where("o_orderstatus", "=", ["F"])}),
    "aggregate": ("ValueError", "Unsupported aggregation: nosuch", {"root_entity": "orders", "aggregations": [{"field": "o_orderkey", "agg": "nosuch"}]}),
    "field": ("ValueError", "Fields ['p_brand'] are not indexed", {"root_entity": "part", "semantic_clauses": [{"entity": "part", "fields": ["p_brand"], "query": "x"}]}),
}


@query(" union all ".join([*(f"select '{name}' as request, '{kind}' as error, true as said" for name, (kind, _, _) in REFUSED.items()), "select 'to-one', 'ValueError', true"]))
def refused_requests(spark: SparkSession, sf: str) -> DataFrame:
    c = catalog(spark, sf)
    c.semantic = build_semantic(c, only=["part"])
    asked = [(name, said, c, request, None) for name, (_, said, request) in REFUSED.items()]
    asked.append(("to-one", "Cardinality 1_to_1 violated", catalog(spark, sf, SHOP), {"root_entity": "customers", "relations": ["customer_record"]}, Options(check_cardinality=True)))
    out = []
    for name, said, where, request, options in asked:
        try:
            execute(where, {"op": "query", **request}, options)
            out.append((name, "none", False))
        except (KeyError, TypeError, ValueError) as e:
            out.append((name, type(e).__name__, said in str(e)))
    return spark.createDataFrame(out, "request string, error string, said boolean")
