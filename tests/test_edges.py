"""What the registered queries don't show: refusals, and what must not happen."""

import json
import os

import pytest
from pyspark.sql import functions as F

from relweave.functions.ratcliff import bound, near_values
from relweave.plans.compiler import Options, execute
from relweave.plans.materialize import materialize, materialize_counts, release, scratch
from relweave.queries.files import Letters
from relweave.runs import results, summary
from relweave.semantic.dense import Store
from relweave.semantic.tfidf import read_json_index
from relweave.sources.catalog import Catalog, Schema
from relweave.streaming import history as stream


def test_store_needs_a_way_to_be_asked(spark):
    with pytest.raises(TypeError, match="vector"):
        Store(spark, lambda q, k: None, model=Letters())
    with pytest.raises(TypeError, match="text"):
        Store(spark)


def test_older_index_files(spark, tmp_path):
    data = {"entity": "a", "kind": "other", "fields": ["f"], "embeddings": [{"id": 1, "vector": [1.0, 0.0]}, {"id": 2, "vectors": {"__all__": [0.0, 1.0], "f": [1.0, 0.0]}}]}
    (tmp_path / "i.json").write_text(json.dumps(data))
    with pytest.raises(ValueError, match="'a'"):
        read_json_index(spark, str(tmp_path / "i.json"), "b")
    index = read_json_index(spark, str(tmp_path / "i.json"), "a", "long")
    assert [tuple(r) for r in index.search_vector("a", [], [0.0, 1.0], 5).collect()] == [(2, 1.0), (1, 0.0)]
    assert [r["score"] for r in index.search_vector("a", "f", [1.0, 0.0], 5).collect()] == [1.0, 1.0]
    with pytest.raises(RuntimeError):
        index.search("a", [], "text")
    data = {"entity": "a", "fields": [], "vocab": ["x", "y"], "idf": [1.0, 2.0], "embeddings": [{"id": "p", "vector": [0.6, 0.8]}, {"id": "q", "vectors": {}}]}
    (tmp_path / "j.json").write_text(json.dumps(data))
    assert [tuple(r) for r in read_json_index(spark, str(tmp_path / "j.json"), "a").search("a", [], "y", 5).collect()] == [("p", 0.8)]


def test_tags(spark):
    rows = [("a", "1", "old", "2024-01-01"), ("a", "2", "new", "2024-02-01"), ("b", "2", "new", "2024-01-05"), ("c", "3", "", "2024-05-01"), ("c", "3", "also", "2024-02-01"), ("d", "4", "never", None)]
    df = spark.createDataFrame(rows, "case_id string, run_id string, tag string, ts string")
    assert [(r["tag"], r["n_runs"], r["n_cases"]) for r in summary.tag_list(df).collect()] == [("also", 1, 1), ("new", 1, 2), ("old", 1, 1), ("never", 1, 1)]
    assert [r["tag"] for r in summary.tag_list(df, "re:^[an]", "name", 2).collect()] == ["also", "never"]
    with pytest.raises(ValueError):
        summary.tag_list(df, sort="size")


def test_keys_are_sent_along_only_where_nothing_is_lost(spark):
    url = {"url": "jdbc:derby:memory:edges;create=true"}
    spark.createDataFrame([(i, f"n{i}") for i in range(40)], "id long, name string").write.format("jdbc").options(**url).option("dbtable", "names").save()
    schema = lambda join: Schema.parse({"entities": [{"name": "names", "columns": [{"name": "id", "type": "int", "pk": True}, {"name": "name"}]}, {"name": "t", "columns": [{"name": "k", "type": "int", "pk": True}, {"name": "id", "type": "int"}]}], "relations": [{"name": "r", "from_entity": "t", "from_column": "id", "to_entity": "names", "to_column": "id", "join": join}]})
    t = spark.createDataFrame([(1, 3), (2, 7), (3, 99), (4, None)], "k long, id long")

    def run(join, keys):
        s = schema(join)
        c = Catalog.merge({"x": Catalog.from_frames(spark, Schema(entities=s.entities[1:]), {"t": t}), "db": Catalog.from_schema(spark, Schema(entities=s.entities[:1], relations=s.relations), "jdbc", options=url, partitions=3)})
        assert c.remote == {"names"}
        df = execute(c, {"op": "query", "root_entity": "t", "relations": ["r"], "limit": None}, Options(push_keys=keys))
        return sorted(map(str, df.collect())), df._jdf.queryExecution().toString()

    for join in ("inner", "left", "right", "outer"):
        plain, _ = run(join, 0)
        rows, plan = run(join, 10)
        assert rows == plain
        assert ("IN (3,7,99)" in plan or "[3,7,99]" in plan) == (join in ("inner", "left"))
        assert run(join, 2)[0] == plain and ",99" not in run(join, 2)[1]
    c = Catalog.from_schema(spark, Schema(entities=schema("left").entities[:1]), "jdbc", options=url, partitions=3)
    assert c.table("names").rdd.getNumPartitions() == 3 and c.table("names").count() == 40


def test_database_is_read_by_executors_of_their_own(spark, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    import pyspark

    names = ['a"b', "", None, " lead, trail ", "new\nline\r\nand\rmore", "маркетинг 🙂 \\ ' \t", "x" * 40_000, "NULL", ',"",']
    (tmp_path / "home/work").mkdir(parents=True)  # the executors' logs go to work in Spark's home
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    spark.createDataFrame([(i, n, 1, -1.5, "s") for i, n in enumerate(names)] + [(None, "no key", 1, None, None)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/in/customer.parquet")
    spark.createDataFrame([(i, k, "F", 500000.0, None, "") for i, k in enumerate([*range(len(names)), 99, None])] + [(77, 1, "F", 400000.0, None, "")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/in/orders.parquet")
    code = f"""
from pyspark.sql import SparkSession
from relweave.queries.files import QUERIES
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.local.dir": "{tmp_path}/local", "spark.checkpoint.dir": "file://{tmp_path}/shared"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
QUERIES["source_jdbc"](spark, "{tmp_path}/in").write.parquet("{tmp_path}/out")
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "_PYSPARK"))} | {"PYTHONPATH": root, "SPARK_HOME": f"{tmp_path}/home", "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    got = {r["o_orderkey"]: r["customer__c_name"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == dict(enumerate([*names, None, None]))


def test_bound_of_similarity(spark):
    from difflib import SequenceMatcher

    words = ["marketing", "markeing", "gnitekram", "market", "sales", "aaaaaaaa", "abc", "", "маркетинг"]
    df = spark.createDataFrame([(w,) for w in words], "value string")
    for needle in words[:-2]:
        for r in df.select("value", bound(F.col("value"), needle).alias("b")).collect():
            assert r["b"] >= SequenceMatcher(None, r["value"], needle).ratio() - 1e-12
    got = {r["value"] for r in near_values(df, "value", ["markeing", "sale"]).collect()}
    assert got == {w for w in words if len(w) >= 3 and any(SequenceMatcher(None, w, n).ratio() >= 0.85 for n in ("markeing", "sale"))}


def test_cuts_are_counted_and_released(spark):
    table, total, most = materialize_counts(spark.range(10).withColumnRenamed("id", "n"), "t")
    assert (table.count(), total, most) == (10, 45, 9)
    assert materialize_counts(spark.range(0).withColumnRenamed("id", "n"), "t")[1:] == (0, 0)
    kept = materialize(spark.range(3), "kept")
    path = kept.inputFiles()[0].removeprefix("file://")
    other = scratch(spark, "never written")
    assert os.path.exists(path) and other not in path
    release()
    assert not os.path.exists(path)


def test_older_versions_of_a_snapshot_are_removed(spark, tmp_path):
    log, snap, state = (str(tmp_path / x) for x in ("log", "snap", "state"))
    for i in range(3):
        results.append_history(spark.createDataFrame([(f"c{i}", str(i), f"2024-01-0{i + 1}", "ok"), ("x", str(i), f"2024-01-0{i + 1}", str(i))], "case_id string, run_id string, ts string, status string"), log)
        stream.follow(stream.history_stream(spark, log), snap, state).awaitTermination()
    assert sorted(x for x in os.listdir(snap) if x.startswith("version")) == ["version=1", "version=2"]
    assert {(r["case_id"], r["status"]) for r in spark.read.parquet(f"{snap}/version=2").collect()} == {("c0", "ok"), ("c1", "ok"), ("c2", "ok"), ("x", "2")}


def test_the_rest_works_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/relweave", tmp_path / "relweave", ignore=lambda d, names: [n for n in names if n in ("__pycache__", "llm")])
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    (tmp_path / "relweave/llm").mkdir()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 100 and "left out" in done.stderr
