"""General operators, catalog, semantic backends, text functions, JSON repair, agent, generator."""

import datetime as dt
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from relweave.functions import text as X
from relweave.functions.json_repair import repair, repair_text, repaired
from relweave.operators.eager import eager_join_aggregate, hot_keys, with_field_total
from relweave.operators.orphans import find_orphans, hot_references, validity
from relweave.operators.rolling import rolling_totals
from relweave.operators.versions import cents, latest
from relweave.plans import paging, skew
from relweave.plans.agent import Agent, Baseline, CatalogProvider, Fetch, Item, Packer, PlanError, Profile, answer_text, catalogue_text, parse_json, parse_plan, plan_prompt, synth_prompt
from relweave.plans.describe import describe
from relweave.plans.materialize import materialize
from relweave.semantic.base import Router
from relweave.semantic.dense import Dense, Store, top_k
from relweave.semantic.tfidf import TfIdf
from relweave.sources.catalog import Catalog, Schema
from relweave.sources.generate import check_commerce, commerce, fingerprint, fingerprint_distributed

DAY = lambda n: dt.datetime(2024, 1, n)


# --- eager aggregation ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["left", "inner"])
def test_eager_aggregation(spark, how):
    rnd = random.Random(1)
    left = [(rnd.choice([None, 1, 1, 1, 1, 2, 3, rnd.randint(4, 30)]), rnd.choice([None, 1, 2, -5]), "x") for _ in range(500)]
    right = [(rnd.choice([None, 1, 2, 2, rnd.randint(4, 40)]), 9) for _ in range(60)]
    a = spark.createDataFrame(left, "k long, v long, n_left string")
    b = spark.createDataFrame(right, "k long, v long")
    got = {tuple(r) for r in eager_join_aggregate(a, b, "k", sums={"total": "v"}, how=how).collect()}
    m, n = Counter(k for k, _ in right if k is not None), Counter(k for k, *_ in left)
    want = set()
    for k in n:
        times = m.get(k, 0) if k is not None else 0
        if times or how == "left":
            values = [v for x, v, _ in left if x == k and v is not None]
            want.add((k, n[k], times, n[k] * max(times, 1), sum(values) * max(times, 1) if values else None))
    assert got == want


def test_eager_edges(spark):
    a, b = spark.createDataFrame([], "k long, v long"), spark.createDataFrame([(1,)], "k long")
    assert eager_join_aggregate(a, b, "k").count() == 0
    one = spark.createDataFrame([(1, 2), (1, None)], "k long, v long")
    assert [tuple(r) for r in eager_join_aggregate(one, b.limit(0), "k", sums={"s": "v"}).collect()] == [(1, 2, 0, 2, 2)]
    with pytest.raises(ValueError):
        eager_join_aggregate(one, b, "k", how="full")
    total = with_field_total(eager_join_aggregate(one, b, "k").withColumn("field", F.lit("f")))
    assert total.first()["n_field"] == 2


def test_hot_keys(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(None,)] * 40 + [(i,) for i in range(2, 12)], "k long")
    assert hot_keys(df, "k") == [1, *range(2, 12)] and hot_keys(df, "k", 2) == [1] and hot_keys(df.limit(0), "k") == []


# --- versions and orphans ---------------------------------------------------------------------------------------


def test_latest(spark):
    rows = [(1, DAY(1), "a"), (1, DAY(3), "b"), (1, DAY(2), "c"), (2, DAY(1), None), (2, DAY(1), None), (3, DAY(1), "x"), (3, DAY(1), "y"), (None, DAY(9), "z"), (4, None, "n")]
    df = spark.createDataFrame(rows, "k long, at timestamp, v string")
    assert {tuple(r) for r in latest(df, "k", "at", ["v"]).collect()} == {(1, "b"), (2, None), (3, "y"), (4, "n")}
    assert latest(df.limit(0), "k", "at", ["v"]).count() == 0


def test_cents(spark):
    df = spark.createDataFrame([(1.005,), (None,), (math.nan,), (-2.5,), (19.99,)], "v double")
    assert [r[0] for r in df.select(cents(F.col("v"))).collect()] == [100, 0, 0, -250, 1999]


def orphan_rows(spark, refs, parents, deleted, hot=None):
    r = spark.createDataFrame(refs, "field string, parent string, row_id long, key long, seen_at timestamp")
    p = spark.createDataFrame(parents, "parent string, key long, loaded_at timestamp")
    d = spark.createDataFrame(deleted, "parent string, key long, deleted_at timestamp")
    return sorted(map(tuple, find_orphans(r, validity(p, d), hot).collect()), key=str)


def test_orphans(spark):
    refs = [("f", "p", i, k, DAY(10)) for i, k in enumerate([1, 2, 3, 4, None, 5, 6])] + [("g", "q", 9, 1, DAY(10)), ("f", "p", 20, 2, None), ("f", "p", 21, 3, None)]
    parents = [("p", 1, DAY(1)), ("p", 1, DAY(20)), ("p", 2, DAY(11)), ("p", 2, DAY(12)), ("p", 4, DAY(10)), ("p", 6, DAY(2)), ("p", None, DAY(1)), ("q", 3, DAY(1))]
    deleted = [("p", 3, DAY(3)), ("p", 3, DAY(4)), ("p", 6, DAY(5)), ("q", 5, DAY(1)), ("p", 2, DAY(1))]
    want = [("f", "2024-01", "deleted", 2), ("f", "2024-01", "late", 1), ("f", "2024-01", "missing", 5), ("f", None, "deleted", 21), ("g", "2024-01", "missing", 9)]
    assert orphan_rows(spark, refs, parents, deleted) == sorted(want, key=str)
    assert orphan_rows(spark, refs, parents, deleted, {"p": [1, 2, 3, 5, None], "q": []}) == sorted(want, key=str)
    assert orphan_rows(spark, [], parents, deleted) == []
    assert {r[2] for r in orphan_rows(spark, refs, [], [])} == {"missing"}


def test_orphans_of_a_hot_key(spark):
    refs = [("f", "p", i, 7 if i % 3 else 8, DAY(10)) for i in range(600)]
    for parents in ([("p", 8, DAY(1))], [("p", 7, DAY(1)), ("p", 8, DAY(11))]):
        got = orphan_rows(spark, refs, parents, [], {"p": [7, 8]})
        assert got == orphan_rows(spark, refs, parents, []) and len(got) in (400, 200)


def test_references_after_the_deletion(spark):
    r = spark.createDataFrame([("f", "p", i, k, t) for i, (k, t) in enumerate([(1, DAY(4)), (1, DAY(5)), (1, DAY(9)), (2, DAY(9)), (2, DAY(1)), (3, DAY(9)), (4, DAY(9)), (1, None), (5, DAY(9)), (6, DAY(9))])], "field string, parent string, row_id long, key long, seen_at timestamp")
    # 1 ended, 2 came again after its deletion, 3 never came but is in the log, 5 has null times only, 6 was in the log before it came
    p = spark.createDataFrame([("p", 1, DAY(2)), ("p", 1, DAY(3)), ("p", 2, DAY(2)), ("p", 2, DAY(8)), ("p", 5, None), ("p", 6, DAY(7))], "parent string, key long, loaded_at timestamp")
    d = spark.createDataFrame([("p", 1, DAY(5)), ("p", 2, DAY(6)), ("p", 3, DAY(1)), ("p", 6, DAY(3))], "parent string, key long, deleted_at timestamp")
    ends = {r["key"]: r["valid_to"] for r in validity(p, d).collect()}
    assert ends == {1: DAY(5), 2: None, 3: None, 5: None, 6: None}
    now = {r["row_id"]: r["kind"] for r in find_orphans(r, validity(p, d)).collect()}
    assert now == {4: "late", 5: "deleted", 6: "missing", 8: "missing"}
    then = {r["row_id"]: r["kind"] for r in find_orphans(r, validity(p, d), ended=True).collect()}
    assert then == now | {1: "deleted", 2: "deleted"}
    again = {r["row_id"]: r["kind"] for r in find_orphans(r, validity(p, d), {"p": {1: 3, 2: 2}}, ended=True).collect()}
    assert again == then


def test_pieces_in_proportion_to_a_keys_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 10)
    monkeypatch.setattr(skew, "PARTS", 4)
    refs = spark.range(400).selectExpr("'f' as field", "'p' as parent", "id as row_id", "case when id < 300 then 1L when id < 398 then 2L end as key", "cast(null as timestamp) as seen_at")
    assert hot_references(refs) == {"p": {1: 3}}  # 300 rows in parts of 100; 98 are no part
    assert hot_references(refs.limit(0)) == {}
    left = refs.select("row_id", "key")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (7, "e")], "key long, v string")
    counts = left.groupBy("key").count()
    hot = skew.hot_pieces(counts, ["key"], "count")
    assert [(n, len(h)) for n, h in hot.hashes.items()] == [(4, 1)]  # three pieces, rounded up
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = skew.salted_join(left, right, ["key"], hot, ["row_id"], how)
        b = left.join(right, ["key"], how)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert skew.salted_join(left, right, ["key"], None, ["row_id"], how).count() == b.count()
    with pytest.raises(TypeError, match="different types"):
        skew.salted_join(left, right.withColumn("key", F.col("key").cast("int")), ["key"], hot, ["row_id"])


# --- rolling totals ---------------------------------------------------------------------------------------------


def test_rolling_over_gaps_and_ends(spark):
    """Gaps as long as the longest period, one less and one more, and activity on the first and the last day."""
    start, end = dt.date(2024, 1, 1), dt.date(2024, 3, 31)
    for seed, gaps in ((1, [5, 4, 6, 1, 12, 5]), (2, [90]), (3, [4, 4, 4]), (4, [1, 1, 30])):
        rows, d = [], 0
        for i, g in enumerate(gaps):
            rows.append((seed, start + dt.timedelta(d), (i + 1) * (-1 if i == 2 else 1)))
            d += g
        rows += [(seed + 10, start, 5), (seed + 10, end, 7), (seed + 10, end, None), (seed + 20, end, -4)]
        got = {(r["c"], r["d"]): (r["a"], r["total_2"], r["total_5"]) for r in rolling_totals(spark.createDataFrame(rows, "c long, d date, a long"), "c", "d", "a", start, end, (2, 5)).collect()}
        days = [start + dt.timedelta(i) for i in range(91)]
        sums = {(c, x): sum(a or 0 for e, y, a in rows if e == c and y == x) for c in {r[0] for r in rows} for x in days}
        want = {(c, x): (v, *[sum(sums.get((c, x - dt.timedelta(i)), 0) for i in range(n)) for n in (2, 5)]) for (c, x), v in sums.items()}
        assert got == want


def test_rolling(spark):
    start, end = dt.date(2024, 1, 1), dt.date(2024, 2, 20)
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, start + dt.timedelta(rnd.randint(-5, 60))]), rnd.choice([None, 5, -3, rnd.randint(0, 100)]), 0) for _ in range(400)]
    got = rolling_totals(spark.createDataFrame(rows, "c long, d date, a long, total_7 long"), "c", "d", "a", start, end).collect()
    day = Counter()
    for c, d, a, _ in rows:
        if c is not None and d is not None and start <= d <= end:
            day[c, d] += a or 0
    known = {c for c, _ in day}
    assert len(got) == len(known) * 51
    for r in got:
        for n in (7, 30):
            want = sum(day[r["c"], r["d"] - dt.timedelta(i)] for i in range(n))
            assert r[f"total_{n}"] == want and math.isclose(r[f"avg_{n}"], want / n)


def test_rolling_edges(spark):
    one = spark.createDataFrame([(1, dt.date(2024, 1, 1), 4)], "c long, d date, a long")
    day = dt.date(2024, 1, 1)
    assert [tuple(r) for r in rolling_totals(one, "c", "d", "a", day, day, (2,)).collect()] == [(1, day, 4, 4, 2.0)]
    assert rolling_totals(one.limit(0), "c", "d", "a", day, day).count() == 0
    with pytest.raises(ValueError):
        rolling_totals(one, "c", "d", "a", day, day - dt.timedelta(1))


def test_materialize(spark):
    df = materialize(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    assert df.schema["x"].dataType.simpleString() == "string" and df.count() == 5 and materialize(df.limit(0)).count() == 0


# --- catalog ----------------------------------------------------------------------------------------------------

PRODUCTS = [(1, "Red Gadget", "A shiny red gadget for everyday use"), (2, "Blue Widget", "Reliable blue widget with extra features"), (3, "Green Gizmo", "Eco-friendly green gizmo made from bamboo")]
SCHEMA = {
    "name": "s",
    "entities": [{"name": "product", "source": "product.csv", "columns": [{"name": "id", "type": "int", "pk": True}, {"name": "name", "semantic": True}, {"name": "price", "type": "float"}, {"name": "since", "type": "date"}], "semantic_text_fields": ["name"]}, {"name": "note", "columns": [{"name": "product_id", "type": "int"}]}],
    "relations": [{"name": "np", "from_entity": "note", "from_column": "product_id", "to_entity": "product", "to_column": "id", "cardinality": "many_to_1"}],
}


def test_schema_round_trip(tmp_path):
    s = Schema.parse(SCHEMA)
    s.save(tmp_path / "s.json")
    assert Schema.load(tmp_path / "s.json") == s and s.entities[0].primary_key == "id"
    assert s.problems() == ["entity note: no source", "entity note: no primary key"]
    bad = Schema.parse({"entities": [{"name": "a", "source": "a", "columns": [{"name": "x", "pk": True}, {"name": "y", "pk": True}], "semantic_text_fields": ["z"]}], "relations": [{"name": "r", "from_entity": "a", "from_column": "q", "to_entity": "b", "to_column": "x"}]})
    assert len(bad.problems()) == 4
    with pytest.raises(ValueError):
        Schema.parse({"relations": [{"name": "r", "from_entity": "a", "from_column": "q", "to_entity": "b", "to_column": "x", "join": "theta"}]})


def test_sources(spark, tmp_path):
    (tmp_path / "product.csv").write_text("id,name,price,since\n1,A,2.5,2024-01-02\n2,B,,\n")
    s = Schema.parse(SCHEMA)
    c = Catalog.from_schema(spark, s, "csv", data_dir=str(tmp_path))
    assert c.table("product").dtypes == [("id", "bigint"), ("name", "string"), ("price", "double"), ("since", "date")]
    assert c.table("product").filter("since = date '2024-01-02'").count() == 1 and "note" not in c.loaders
    c.table("product").createOrReplaceTempView("product")
    assert Catalog.from_schema(spark, s, "table").table("product").count() == 2
    named = Catalog.from_schema(spark, s, "table", table_name_resolver=lambda e: "product" if e.name == "note" else None)
    assert named.table("note").count() == 2
    for bad, error in (({"format": "csv"}, TypeError), ({"format": "jdbc"}, TypeError), ({"format": "xml"}, ValueError)):
        with pytest.raises(error):
            Catalog.from_schema(spark, s, **bad)
    with pytest.raises(KeyError):
        c.table("note")
    assert c.entities_frame().count() == 5 and c.relations_frame().first()["cardinality"] == "many_to_1"


def test_merge_conflicts(spark):
    s = Schema.parse(SCHEMA)
    turned = Schema.parse({**SCHEMA, "entities": [{**SCHEMA["entities"][0], "columns": SCHEMA["entities"][0]["columns"][::-1]}]})
    other = Schema.parse({"entities": [{"name": "product", "columns": [{"name": "id"}]}]})
    a, b, c = (Catalog.from_frames(spark, x, {}) for x in (s, turned, other))
    assert len(Catalog.merge({"a": a, "b": b}).schema.entities) == 2
    with pytest.raises(ValueError, match="entity 'product'"):
        Catalog.merge({"a": a, "c": c})


def test_violations(spark):
    s = Schema.parse(SCHEMA)
    c = Catalog.from_frames(spark, s, {"product": spark.range(3), "note": spark.createDataFrame([(1,), (9,), (9,), (None,)], "product_id long")})
    assert [tuple(r) for r in c.violations().collect()] == [("np", "9", 2)]


# --- semantic search --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(PRODUCTS, "id long, name string, description string")
    return TfIdf.build(df, "product", "id", ["name", "description"])


def test_tfidf(spark, index, tmp_path):
    find = lambda q, f=(), k=10, ix=index: [r["id"] for r in ix.search("product", f, q, k).collect()]
    assert find("red shiny gadget widget", ["name", "description"], 2) == [1, 2]
    assert find("bamboo", ["name", "description"]) == [3] and find("bamboo", ["name"]) == [] and find("bamboo", "description") == [3]
    assert find("gizmos", ["name"]) == [1, 2, 3] and find("unknown") == [] and find("") == []
    with pytest.raises(ValueError):
        find("x", ["nothing"])
    with pytest.raises(KeyError):
        index.search("other", [], "x")
    index.write(str(tmp_path / "ix"))
    again = TfIdf.read(spark, str(tmp_path / "ix"), "product", ["name", "description"])
    assert find("red shiny gadget widget", [], 3, again) == find("red shiny gadget widget", [], 3)
    assert [r["id"] for r in Router({"product": again}).search("product", [], "bamboo").collect()] == [3]


def test_tfidf_scores(index):
    n, docs = 3, [" ".join(p[1:]).lower().replace("-", " ").split() for p in PRODUCTS]
    fold = lambda t: {"widget": "gadget", "gizmo": "gadget"}.get(t, t)
    docs = [[fold(t) for t in d] for d in docs]
    idf = {t: math.log((1 + n) / (1 + sum(t in d for d in docs))) + 1 for d in docs for t in d}

    def unit(words):
        w = {t: c * idf[t] for t, c in Counter(words).items() if t in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    q = unit(["red", "gadget"])
    want = {i + 1: sum(q[t] * unit(d).get(t, 0) for t in q) for i, d in enumerate(docs)}
    got = {r["id"]: r["score"] for r in index.search("product", [], "red gadget").collect()}
    assert got.keys() == {i for i, s in want.items() if s > 0} and all(math.isclose(got[i], want[i]) for i in got)


def test_tfidf_cyrillic_and_nulls(spark):
    rows = [(1, "Учёт кадров", None), (2, "Платежи и биллинг", "приём платежей"), (3, None, None)]
    ix = TfIdf.build(spark.createDataFrame(rows, "id long, a string, b string"), "s", "id", ["a", "b"])
    assert ix.search("s", [], "платежи и биллинг", 1).first()["id"] == 2


def model():
    class Model:  # local, so that workers needn't import the tests
        def embed_documents(self, texts):
            return [self.embed_query(t) for t in texts]

        def embed_query(self, text):
            return [1.0, 0.0] if "alpha" in text.lower() else [0.0, 1.0] if "beta" in text.lower() else [0.0, 0.0]

    return Model()


def test_dense(spark):
    df = spark.createDataFrame([(1, "Alpha", "First alpha"), (2, "Beta", "Second beta"), (3, None, None)], "id long, name string, description string")
    ix = Dense.build(df, "demo", "id", ["name", "description"], model())
    assert [(r["id"], r["score"]) for r in ix.search("demo", ["name", "description"], "alpha").collect()] == [(1, 2.0), (2, 0.0), (3, 0.0)]
    with pytest.raises(RuntimeError):
        Dense("demo", ["name"], ix.vectors).search("demo", [], "alpha")
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0]), (3, None)], "id long, vector array<double>")
    assert [(r["id"], round(r["score"], 6)) for r in top_k(v, [0.0, 9.0], 5).collect()] == [(2, 1.0), (1, 0.8)]


@pytest.mark.parametrize(
    "rows,fields,kind,k,want",
    [
        ([("1", "product", "name", 0.05), ("2", "product", "description", 0.3), ("3", "other", None, 0.01)], ["name", "description"], "distance", 5, ["1", "2"]),
        ([("1", "product", "name", 0.2), ("2", "product", "description", 0.1)], ["description"], "distance", 3, ["2"]),
        ([("row-1", None, None, 0.8), ("row-2", None, None, 0.6)], [], "similarity", 2, ["row-1", "row-2"]),
        ([("1", "product", None, 0.5), ("2", "product", None, 0.1), ("3", "other", None, 0.01), (None, "product", None, 0.0)], [], "distance", 2, ["2", "1"]),
    ],
)
def test_store(spark, rows, fields, kind, k, want):
    def fetch(query, n):
        data = [({a: b for a, b in (("id", i), ("entity", e), ("field", f)) if b is not None}, v) for i, e, f, v in rows]
        return spark.createDataFrame(data, "metadata map<string,string>, value double")

    assert [r["id"] for r in Store(spark, fetch, score_kind=kind).search("product", fields, "q", k).collect()] == want


# --- text -------------------------------------------------------------------------------------------------------


def test_text_functions(spark):
    df = spark.createDataFrame([("  Marketing  ",), ("Foo   Bar\nBaz",), ("\u00a0Ёж \u2003X",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(X.norm(F.col("s"))).collect()] == ["marketing", "foo bar baz", "ёж x", None, ""]
    assert X.norm_value("\u00a0Ёж \u2003X") == "ёж x"
    assert [r[0] for r in df.select(X.token_estimate(F.col("s"))).collect()][1:] == [3, 1, 1, 1]
    t = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("1704067200",), ("x",), ("2024-01-01 02:00:00+02:00",)], "t string")
    assert [r[0] for r in t.select(X.epoch_seconds(F.col("t"))).collect()] == [1704067200.0, 1704067200.0, None, 1704067200.0]
    d = spark.createDataFrame([(0.0,), (1.0,), (-2.0,)], "d double")
    assert [r[0] for r in d.select(X.similarity_from_distance(F.col("d"))).collect()] == [1.0, 0.5, -2.0]
    rows = [("x ", " x", None, None), ("x1", None, "[0-9]", None), ("abc", None, None, "bd"), (None, None, None, "b"), ("x", None, None, None)]
    c = spark.createDataFrame(rows, "a string, e string, r string, p string")
    got = [r[0] and (r[0]["mode"], r[0]["passed"]) for r in c.select(X.answer_check(*map(F.col, "aerp"))).collect()]
    assert got == [("exact", True), ("regex", True), ("contains", False), ("none", False), None]
    s = spark.createDataFrame([("boom", None, False), (None, True, False), (None, False, False), (None, None, True), (None, None, False)], "e string, p boolean, o boolean")
    assert [r[0] for r in s.select(X.case_status(*map(F.col, "epo"))).collect()] == ["error", "ok", "mismatch", "plan_only", "unchecked"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"a": 1}', {"a": 1}),
        ('Sure!\n```json\n{"a": [1, 2]}\n```\nbye', {"a": [1, 2]}),
        ("```\n{'a': 'b'}\n```", {"a": "b"}),
        ("<think>{\"x\": 1}</think>{\"a\": 2}", {"a": 2}),
        ("{a: 1, 'b': True, c: None, d: word, e: two words}", {"a": 1, "b": True, "c": None, "d": "word", "e": "two words"}),
        ('{"a": 1, // note\n "b": 2 /* x */, # y\n}', {"a": 1, "b": 2}),
        ('{"a": 1 "b": 2}', {"a": 1, "b": 2}),
        ('{"a": "x"\n"b": "y"}', {"a": "x", "b": "y"}),
        ('["a" "b", ]', ["a", "b"]),
        ('{"a": [1, 2, ...], "b": 3, ...}', {"a": [1, 2], "b": 3}),
        ('{"a": {"b": [1, 2', {"a": {"b": [1, 2]}}),
        ('{"a": [1, 2}, ', {"a": [1, 2]}),
        ('{"a": 1]}', {"a": 1}),
        ('{"a": "line\nbreak\tand tab"}', {"a": "line\nbreak\tand tab"}),
        ('{"a": "he said "hi" to me", "b": 1}', {"a": 'he said "hi" to me', "b": 1}),
        ('"{\\"a\\": 1}"', {"a": 1}),
        ('{\\"a\\": \\"b\\"}', {"a": "b"}),
        ('{"a": "{\\"b\\": [1]}"}', {"a": {"b": [1]}}),
        ("“{”", {}),
        ('{“a”: “b”}', {"a": "b"}),
        ('{"a": "caf\\u00e9 \\ud83d\\ude42"}', {"a": "café 🙂"}),
        ('{"a": 1.5e3, "b": -2, "c": 1_000}', {"a": 1500.0, "b": -2, "c": 1000}),
        ('text [not json] then {"a": 1}', {"a": 1}),
        ('{"path": "C:\\dir"}', {"path": "C:\\dir"}),
        ('{"url": "http://x.y/z"}', {"url": "http://x.y/z"}),
        ("{url: 'http://x.y/z'}", {"url": "http://x.y/z"}),
        ("{}", {}),
        ("nothing", None),
        ("", None),
    ],
)
def test_json_repair(raw, want):
    if want is None:
        with pytest.raises(ValueError):
            repair(raw)
    else:
        assert repair(raw) == want
        assert json.loads(repair_text(raw)) == want


def test_json_repair_never_fails_otherwise(spark):
    rnd = random.Random(6)
    for _ in range(3000):
        s = "".join(rnd.choice('{}[]":,\'\\/ab1. \n#…“(') for _ in range(rnd.randint(0, 40)))
        try:
            assert isinstance(repair(s), (dict, list))
        except ValueError:
            pass
    value = {"a": [1, {"b": "c, d"}], "e": None, "f": "it's"}
    text = json.dumps(value)
    df = spark.createDataFrame([(text,), (text.replace('"', "'").replace("it's", "its"),), (None,), ("x",)], "s string")
    got = [r[0] and json.loads(r[0]) for r in df.select(repaired("s")).collect()]
    assert got == [value, {**value, "f": "its"}, None, None]


# --- agent ------------------------------------------------------------------------------------------------------


class Source:
    def __init__(self, text):
        self.text, self.calls = text, []

    def fetch(self, feature, selectors=None):
        self.calls.append(selectors)
        return self.text

    def filter(self, obj, selectors):
        return obj[:3]

    def serialize(self, obj):
        return obj


def test_agent():
    a, b, c = Source("alpha" * 3), Source("beta" * 100), Source("gamma")
    saved, seen = {}, []
    plan = '```json\n{"required_context": ["a"], "context_plan": [{"provider": "a", "mode": "slice"}, {"provider": "b", "max_tokens": 5}, {"provider": "nothing"}, {"bad": 1}, {"provider": 3}]}\n```'
    drafts = iter(["draft", "better"])

    def synth(feature, context, p):
        seen.append(context)
        return {"output": next(drafts)}

    class Check:
        name = "check"

        def check(self, draft):
            if draft == "draft":
                raise RuntimeError("no")
            return []

    again = iter(['{"stop": false, "add_specs": [{"provider": "a", "selectors": {"x": 1}}, {"provider": "a", "mode": "slice"}]}'])
    agent = Agent(lambda f, ctx: plan, synth, {"a": a, "b": b, "c": c}, Packer(50, lambda t: t[:8]), str.upper, saved.__setitem__, (Check(),), baseline=(Baseline(Fetch("c")),), refetch=lambda f, ctx, p: next(again), profile=Profile(lite_context_keys=("c",)))
    assert agent.run("q") == "BETTER" and saved == {"q": "BETTER"}
    assert seen[0] == {"a": "alp", "a#2": "alphaalphaalpha", "b": "beta" * 5, "c": "gamma"}
    assert seen[1]["issues"] == "check: the draft could not be checked (RuntimeError: no)"


def test_agent_without_plan_and_packing():
    a = Source("x" * 400)
    agent = Agent(lambda f, c: '{"required_context": ["a"]}', lambda f, c, p: c.get("a", "-"), {"a": a}, Packer(10, lambda t: "short"))
    assert agent.run("q") == "short"
    assert Agent(lambda f, c: '{"required_context": ["a"]}', lambda f, c, p: c.get("a", "-"), {"a": a}, Packer(10, lambda t: "y" * 99)).run("q") == "-"
    items = [Item(k, None, "t", n) for k, n in (("big", 9), ("small", 2), ("mid", 4))]
    assert [i.key for i in Packer(6, lambda t: "z" * 400).pack(items)] == ["small", "mid"]
    required = Agent(lambda f, c: "{}", lambda f, c, p: ",".join(c), {"a": a}, Packer(1, lambda t: "y" * 99), baseline=(Baseline(Fetch("a")),))
    assert required.run("q") == "a"


def test_plans():
    p = parse_plan("{'context_plan': [{'provider': 'a', 'selectors': {'op': 'schema'}}], 'entities': [{'name': 'x', 'change': 'UPDATE', 'fields': [{'change': '?'}, 3]}, 4], 'constraints': ['c']}")
    assert p.context_plan == (Fetch("a", "full", {"op": "schema"}),) and p.constraints == ("c",)
    assert p.entities[0]["change"] == "update" and p.entities[0]["fields"] == [{"change": "new"}]
    for bad in ("[1]", "nothing", '{"required_context": "a"}', '{"constraints": {"a": 1}}'):
        with pytest.raises(PlanError):
            parse_plan(bad)
    assert parse_json('{"a": 1, "b": 2}', "a") == {"a": 1}
    with pytest.raises(PlanError):
        parse_json("{}", "a")
    assert [answer_text(x) for x in ("t", {"text": "a"}, {"content": "b"}, {"z": 1}, 5)] == ["t", "a", "b", '{"z": 1}', "5"]


def test_catalog_as_provider(spark):
    s = Schema.parse({**SCHEMA, "description": "Things", "planning_hints": ["be quick"]})
    c = Catalog.from_frames(spark, s, {"product": spark.createDataFrame([(1, "A", 1.0, None)], "id long, name string, price double, since date")})
    p = CatalogProvider("shop", c)
    assert p.serialize(p.fetch("q", {"op": "query", "root_entity": "product", "select": [{"expr": "name"}]})) == "name=A"
    assert p.serialize(p.fetch("q", {"op": "schema"})) == "Schema: entities=(product, note); relations=(np)"
    info = describe("shop", c)
    assert "be quick" in info.description and info.selectors_schema["oneOf"][2]["properties"]["root_entity"]["enum"] == ["product", "note"]
    for example in info.examples:
        assert json.loads(example)["op"] in ("schema", "query", "semantic_only")
    text = catalogue_text({"shop": p, "other": Source("x")})
    cards = [json.loads(line) for line in text.splitlines()]
    assert [c["source"] for c in cards] == ["shop", "other"] and cards[1]["can"] == ["fetch", "narrow"] and cards[0]["takes"]["oneOf"] and catalogue_text({}) == "There is no source to ask."
    prompt = plan_prompt(Profile(constraints=("c",), focus_hints=("f",)), {"shop": p}, "q", {"k": "v"})
    assert "context_plan" in prompt and "[k]\nv" in prompt
    assert "Accepted if: yes" in synth_prompt(Profile(acceptance_criteria=("yes",)), "q", {}, parse_plan("{}"))


# --- generator --------------------------------------------------------------------------------------------------


def test_generator(spark, tmp_path):
    t = commerce(spark, 60, seed=1)
    check_commerce(t, 60)
    assert t["products"].count() == 200 and t["orders"].columns == ["order_id", "customer_id", "order_date", "status", "channel", "order_total"]
    again = commerce(spark, 60, seed=1)["orders"].repartition(3)
    assert t["orders"].exceptAll(again).isEmpty() and not t["orders"].exceptAll(commerce(spark, 60, seed=2)["orders"]).isEmpty()
    with pytest.raises(ValueError):
        check_commerce({**t, "customers": t["customers"].limit(59)}, 60)
    (tmp_path / "a").mkdir()
    (tmp_path / ".runs").mkdir()
    (tmp_path / "a" / "x").write_text("123")
    before = fingerprint(tmp_path)
    (tmp_path / ".runs" / "y").write_text("123")
    assert fingerprint(tmp_path) == before and before["files_count"] == 1 and before["bytes_total"] == 3
    row = fingerprint_distributed(spark, str(tmp_path)).first()
    assert (row["files_count"], row["bytes_total"]) == (1, 3)
    (tmp_path / "a" / "z").write_text("4")
    assert fingerprint(tmp_path)["hash"] != before["hash"] and fingerprint_distributed(spark, str(tmp_path)).first()["hash"] != row["hash"]


def test_indexes_of_a_catalog(spark, tmp_path):
    from relweave.semantic.build import build_semantic

    schema = Schema.parse({"entities": [{"name": "product", "columns": [{"name": "id"}, {"name": "name"}, {"name": "description"}], "semantic_text_fields": ["name", "description"]}, {"name": "other", "columns": [{"name": "id"}]}]})
    c = Catalog.from_frames(spark, schema, {"product": spark.createDataFrame(PRODUCTS, "id long, name string, description string"), "other": spark.range(1)})
    with pytest.warns(UserWarning, match="primary key"):
        first = build_semantic(c, str(tmp_path))
    assert list(first.backends) == ["product"] and first.search("product", [], "bamboo").first()["id"] == 3
    changed = Catalog.from_frames(spark, schema, {"product": c.table("product").limit(0)})
    with pytest.warns(UserWarning):
        again = build_semantic(changed, str(tmp_path))
    assert again.search("product", [], "bamboo").first()["id"] == 3  # the index that is there is used
    with pytest.warns(UserWarning):
        assert build_semantic(changed, str(tmp_path / "new")).search("product", [], "bamboo").count() == 0
    with pytest.raises(KeyError):
        first.search("other", [], "x")


# --- paging -----------------------------------------------------------------------------------------------------


def test_skip_without_a_single_task(spark):
    rows = [(i % 7 if i % 5 else None, f"v{i % 11}", i) for i in range(200)] + [(3, "same", 0)] * 20
    df = spark.createDataFrame(rows, "a long, b string, c long").repartition(4)
    up = lambda r: (r["a"] is None, r["a"] or 0)
    for offset in (0, 1, 37, 60, 65, 100, 150, 219, 220, 500):
        got = paging.skip(df, [(F.col("a"), False)], offset, ("a", "b", "c")).collect()
        assert len(got) == max(0, 220 - offset)
        assert list(map(up, got)) == sorted(map(up, df.collect()))[offset:]
        down = paging.skip(df, [(F.col("b"), True), (F.col("c"), False)], offset).collect()
        assert [(r["b"], r["c"]) for r in down] == sorted(((b, c) for _, b, c in rows), key=lambda x: ([-ord(y) for y in x[0]] + [1], x[1]))[offset:]
    # pages don't overlap and leave nothing out, whatever ties
    pages = [tuple(r) for o in range(0, 220, 50) for r in paging.page(df, [(F.col("a"), False)], 50, o, ("a", "b", "c")).collect()]
    assert len(pages) == 220
    limit, paging.TOP = paging.TOP, 0
    try:
        pages = [tuple(r) for o in range(0, 220, 50) for r in paging.page(df, [(F.col("a"), False)], 50, o, ("a", "b", "c")).collect()]
    finally:
        paging.TOP = limit
    assert sorted(pages, key=str) == sorted(map(tuple, df.collect()), key=str)
    assert paging.skip(df.limit(0), [(F.col("a"), False)], 3).count() == 0
    plan = paging.skip(df, [(F.col("a"), False)], 37, ("a", "b", "c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan.replace("LocalLimit 1", "").replace("GlobalLimit 1", "") and "Offset" not in plan
