"""The query language over small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from relweave.plans.compiler import Options, compile_request, execute
from relweave.plans.shape import nested, rows, serialize
from relweave.semantic.base import Fixed
from relweave.sources.catalog import Catalog, Schema


def entity(name, columns, key="id"):
    return {"name": name, "columns": [{"name": c, "pk": c == key} for c in columns]}


def relation(name, left, right, cardinality="many_to_1", join="left"):
    (a, x), (b, y) = left.split("."), right.split(".")
    return {"name": name, "from_entity": a, "from_column": x, "to_entity": b, "to_column": y, "cardinality": cardinality, "join": join}


@pytest.fixture(scope="module")
def shop(spark):
    schema = Schema.parse(
        {
            "entities": [entity("customer", ["id", "name", "notes"]), entity("order", ["id", "customer_id", "total", "status"])],
            "relations": [relation("order_customer", "order.customer_id", "customer.id"), relation("order_customer_ref", "order.customer_id", "customer.id")],
        }
    )
    frames = {
        "customer": spark.createDataFrame([(1, "Alice", "pharma buyer"), (2, "Bob", "retail")], "id long, name string, notes string"),
        "order": spark.createDataFrame([(101, 1, 120, "shipped"), (102, 2, 80, "pending"), (103, 1, 200, "pending")], "id long, customer_id long, total long, status string"),
    }
    return Catalog.from_frames(spark, schema, frames)


def with_matches(shop, matches):
    found = shop.spark.createDataFrame([("customer", i, s) for i, s in matches], "entity string, id long, score double")
    return Catalog(shop.spark, shop.schema, shop.loaders, Fixed(found))


def q(root, **more):
    return {"op": "query", "root_entity": root, **more}


def where(field, op, value, entity=None):
    return {"type": "comparison", "field": field, "op": op, "value": value, "entity": entity}


def ids(df, name="id"):
    return [r[name] for r in df.select(name).collect()]


def test_join_and_shape(shop):
    result = compile_request(shop, q("order", relations=["order_customer"], limit=5))
    got = sorted(rows(result), key=lambda r: r["data"]["id"])
    assert len(got) == 3 and got[0]["related"]["customer"]["name"] == "Alice"
    assert got[0]["data"] == {"id": 101, "customer_id": 1, "total": 120, "status": "shipped"}
    assert nested(result).select(F.max("related.customer.name")).first()[0] == "Bob"
    assert result.meta["relations_used"] == ["order_customer"]


def test_filter_tree(shop):
    tree = {"type": "logical", "op": "or", "clauses": [where("total", ">", 150), {"type": "logical", "op": "and", "clauses": [where("status", "=", "pending"), where("name", "like", "Ali", "customer")]}]}
    assert ids(execute(shop, q("order", relations=["order_customer"], filters=tree))) == [103]
    empty = {"type": "logical", "op": "and", "clauses": []}
    assert len(ids(execute(shop, q("order", filters=empty)))) == 3


def test_grouping(shop):
    got = execute(shop, q("order", relations=["order_customer"], group_by=[{"entity": "customer", "field": "name"}], aggregations=[{"field": "total", "agg": "sum", "alias": "total_spend"}]))
    assert [tuple(r) for r in got.collect()] == [("Alice", 320), ("Bob", 80)] and got.columns == ["customer__name", "total_spend"]
    assert [tuple(r) for r in execute(shop, q("order", group_by=[{"field": "status"}])).collect()] == [("pending", 2), ("shipped", 1)]
    one = execute(shop, q("order", aggregations=[{"field": "order.total", "agg": "max"}], limit=0, offset=9))
    assert one.columns == ["max_order.total"] and one.first()[0] == 200


def test_aggregate_names_are_checked(shop):
    with pytest.raises(ValueError, match="Unsupported aggregation"):
        execute(shop, q("order", aggregations=[{"field": "total", "agg": "sum(x); drop"}]))


def test_semantic_clauses(shop):
    clause = {"entity": "customer", "query": "x", "fields": []}
    base = dict(relations=["order_customer"])
    strong = with_matches(shop, [(1, 0.9), (2, 0.3)])
    got = execute(strong, q("order", **base, semantic_clauses=[{**clause, "threshold": 0.8}]))
    assert [r["customer_id"] for r in got.collect()] == [1, 1]
    two = with_matches(shop, [(2, 0.9), (1, 0.4)])
    boost = {**clause, "mode": "boost"}
    assert ids(execute(two, q("order", **base, semantic_clauses=[{**boost, "threshold": 0.5}], select=[{"expr": "id"}]))) == [102, 101, 103]
    assert ids(execute(two, q("order", **base, semantic_clauses=[clause], select=[{"expr": "id"}], limit=2))) == [102, 101]
    groups = execute(two, q("order", **base, semantic_clauses=[boost], group_by=[{"field": "status"}], aggregations=[{"field": "id", "agg": "count"}]))
    assert [r["status"] for r in groups.collect()] == ["pending", "shipped"]
    assert ids(execute(two, q("order", **base, semantic_clauses=[boost], filters=where("status", "=", "pending"), select=[{"expr": "id"}]))) == [102, 103]
    assert ids(execute(with_matches(shop, []), q("order", **base, semantic_clauses=[clause]))) == []
    twice = with_matches(shop, [(1, 0.1), (1, 0.5), (2, 0.3)])
    assert ids(execute(twice, q("order", **base, semantic_clauses=[clause], select=[{"expr": "id"}]))) == [101, 103, 102]
    with pytest.raises(RuntimeError, match="semantic backend"):
        execute(shop, q("order", **base, semantic_clauses=[clause]))


def test_two_relations_to_one_entity(shop):
    both = q("order", relations=["order_customer", "order_customer_ref"], filters=where("order_customer_ref.name", "=", "Bob"))
    result = compile_request(shop, both)
    assert ids(result.frame) == [102] and set(result.related) == {"order_customer", "order_customer_ref"}
    with pytest.raises(ValueError, match="Ambiguous reference"):
        execute(shop, q("order", relations=["order_customer", "order_customer_ref"], select=[{"expr": "customer.name"}]))
    with pytest.raises(ValueError, match="Duplicate relation"):
        execute(shop, q("order", relations=["order_customer", "order_customer"]))


def test_errors(shop):
    with pytest.raises(TypeError, match="list or tuple"):
        execute(shop, q("order", filters=where("status", "in", "pending")))
    with pytest.raises(TypeError, match="single value"):
        execute(shop, q("order", filters=where("status", "=", ["pending"])))
    for bad in ({}, {"op": "nothing"}, {"op": "query"}, q("order", filters=where("status", "~", 1)), q("order", filters={"type": "logical", "op": "xor", "clauses": []})):
        with pytest.raises(ValueError):
            execute(shop, bad)
    for bad in (q("order", select=[{"expr": "nothing"}]), q("nothing"), q("order", relations=["nothing"])):
        with pytest.raises(KeyError):
            execute(shop, bad)
    with pytest.raises(ValueError, match="Unknown entity"):
        execute(shop, q("order", select=[{"expr": "customer.name"}]))


def test_nameless_relations_and_disconnected_ones(spark, shop):
    schema = Schema.parse({"entities": [entity("a", ["id", "b"]), entity("b", ["id"]), entity("c", ["id"])], "relations": [relation("", "a.b", "b.id"), relation("", "a.id", "b.id"), relation("bc", "b.id", "c.id")]})
    c = Catalog.from_frames(spark, schema, {n: spark.createDataFrame([(1, 1)], "id long, b long") for n in "abc"})
    with pytest.raises(ValueError, match="set distinct relation.name"):
        execute(c, q("a", relations=["", ""]))
    with pytest.raises(ValueError, match="Neither entity"):
        execute(c, q("a", relations=["bc"]))


@pytest.fixture(scope="module")
def teams(spark):
    schema = Schema.parse({"entities": [entity("team", ["id", "name", "n"])]})
    frame = spark.createDataFrame([(1, "Marketing", 1), (2, "marketing ", 2), (3, "Маркетинг", 3), (4, "sales", 4), (5, None, 5), (6, " foo   Bar ", 6), (7, "100%", 7)], "id long, name string, n long")
    return Catalog.from_frames(spark, schema, {"team": frame})


@pytest.mark.parametrize(
    "op,value,tolerance,strict,want",
    [
        ("=", "MARKETING", "none", False, [1, 2]),
        ("=", "маркетинг", "none", False, [3]),
        ("=", "markeing", "ratcliff", False, [1, 2]),
        ("!=", "markeing", "ratcliff", False, [3, 4, 6, 7]),
        ("in", ["markeing", "sale"], "ratcliff", False, [1, 2, 4]),
        ("=", "market", "contains", False, [1, 2]),
        ("!=", "market", "contains", False, [3, 4, 6, 7]),
        ("=", "market", "none", False, []),
        ("in", [" marketing", "sales"], "none", False, [1, 2, 4]),
        ("not_in", [" marketing", "sales"], "none", False, [3, 6, 7]),
        ("=", "MARKETING", "none", True, []),
        ("!=", "Marketing", "none", True, [2, 3, 4, 6, 7]),
        ("=", "foo bar", "none", False, [6]),
        ("like", "RKET", "none", False, [1, 2]),
        ("like", "%", "none", False, [7]),
        ("like", "rket", "none", True, [1, 2]),
        ("like", "RKET", "none", True, []),
        ("ilike", "RKET", "none", True, [1, 2]),
        ("like", "an", "none", False, []),
        ("not_in", [], "none", False, [1, 2, 3, 4, 5, 6, 7]),
        ("in", [], "none", False, []),
    ],
)
def test_text_comparisons(teams, op, value, tolerance, strict, want):
    df = execute(teams, q("team", filters=where("name", op, value), case_sensitivity=strict), Options(tolerance=tolerance))
    assert sorted(ids(df)) == want and df.columns == ["id", "name", "n"]


@pytest.mark.parametrize("op,value,want", [(">", "2", [3, 4, 5, 6, 7]), (">", 2.5, [3, 4, 5, 6, 7]), ("=", "x", []), ("in", [1, "2"], [1, 2]), ("<=", 1, [1]), ("like", 7, [7])])
def test_operands_take_the_columns_type(teams, op, value, want):
    assert sorted(ids(execute(teams, q("team", filters=where("n", op, value))))) == want


def test_self_join(spark):
    schema = Schema.parse({"entities": [entity("order", ["id", "parent_id", "total"])], "relations": [relation("parent_order", "order.parent_id", "order.id")]})
    c = Catalog.from_frames(spark, schema, {"order": spark.createDataFrame([(1, None, 100), (2, 1, 50)], "id long, parent_id long, total long")})
    got = {r["data"]["id"]: r["related"]["parent_order"]["id"] for r in rows(compile_request(c, q("order", relations=["parent_order"])))}
    assert got == {1: None, 2: 1}


@pytest.fixture(scope="module")
def blocks(spark):
    one = Schema.parse({"name": "blocks", "entities": [entity("block", ["id", "name", "group"])], "relations": [relation(f"bs_{j}", "block.id", "system.block_id", "1_to_many", j) for j in ("inner", "left", "right", "outer")]})
    two = Schema.parse({"name": "systems", "entities": [entity("system", ["id", "block_id", "code"])]})
    a = Catalog.from_frames(spark, one, {"block": spark.createDataFrame([(1, "A", "g1"), (2, "B", "g2"), (3, "C", "g1")], "id long, name string, `group` string")})
    b = Catalog.from_frames(spark, two, {"system": spark.createDataFrame([(10, 1, "S1"), (11, 1, "S2"), (12, 2, "S3"), (13, None, "S4"), (14, 9, "S5")], "id long, block_id long, code string")})
    return Catalog.merge({"blocks": a, "systems": b})


@pytest.mark.parametrize("join,want", [("inner", ["AS1", "AS2", "BS3"]), ("left", ["AS1", "AS2", "BS3", "C-"]), ("right", ["-S4", "-S5", "AS1", "AS2", "BS3"]), ("outer", ["-S4", "-S5", "AS1", "AS2", "BS3", "C-"])])
def test_joins_across_sources(blocks, join, want):
    result = compile_request(blocks, q("block", relations=[f"bs_{join}"]))
    assert sorted((r["name"] or "-") + (r["system__code"] or "-") for r in result.frame.collect()) == want
    assert result.meta["sources"] == ["blocks", "systems"]


def test_aggregates_across_sources(blocks):
    def run(**more):
        return [tuple(r) for r in execute(blocks, q("block", relations=["bs_left"], **more)).collect()]

    count = [{"field": "system.id", "agg": "count"}]
    assert run(group_by=[{"field": "name"}], aggregations=count) == [("A", 2), ("B", 1), ("C", 0)]
    assert run(aggregations=count) == [(3,)]
    assert run(group_by=[{"field": "group"}]) == [("g1", 3), ("g2", 1)]
    assert run(group_by=[{"field": "system.code"}]) == [("S1", 1), ("S2", 1), ("S3", 1), (None, 1)]


def test_cardinality(spark):
    def c(rows_, cardinality="many_to_1"):
        schema = Schema.parse({"entities": [entity("employee", ["id", "department_id"]), entity("department", ["id", "title"])], "relations": [relation("d", "employee.department_id", "department.id", cardinality)]})
        return Catalog.from_frames(spark, schema, {"employee": spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, department_id long"), "department": spark.createDataFrame(rows_, "id long, title string")})

    check = Options(check_cardinality=True)
    good = execute(c([(1, "Eng"), (2, "HR")]), q("employee", relations=["d"]), check)
    assert sorted(r["department__title"] for r in good.collect()) == ["Eng", "Eng", "HR"]
    for kind in ("many_to_1", "1_to_1"):
        with pytest.raises(ValueError, match=f"Cardinality {kind} violated"):
            execute(c([(1, "Eng"), (1, "Dup"), (2, "HR")], kind), q("employee", relations=["d"]), check)
    assert execute(c([(1, "Eng"), (1, "Dup"), (2, "HR")]), q("employee", relations=["d"])).count() == 5
    with pytest.raises(ValueError, match="violated"):  # walked backwards, 1_to_many becomes to-one
        execute(c([(1, "Eng"), (2, "HR")], "1_to_many"), q("department", relations=["d"]), check)


def test_large_joins(spark):
    def joined(left, right, **more):
        schema = Schema.parse({"entities": [entity("left", ["id", "k"]), entity("right", ["id", "k"])], "relations": [relation("lr", "left.k", "right.k", "many_to_many", "inner")]})
        return execute(Catalog.from_frames(spark, schema, {"left": left, "right": right}), q("left", relations=["lr"], **more))

    n = lambda a, b, k: spark.range(a, b).select("id", F.expr(k).alias("k"))
    assert joined(n(0, 12000, "id"), n(11975, 23975, "id"), limit=None).count() == 25
    assert joined(n(0, 6000, "id"), n(0, 6000, "id div 6").union(n(6000, 8000, "id * 100")), limit=None).count() == 6000
    assert joined(n(0, 6000, "id"), n(0, 6000, "7").union(n(6000, 8000, "id * 100")), limit=None).count() == 6000
    assert joined(n(0, 5000, "1"), n(0, 1000, "1"), limit=50).count() == 50


def test_null_keys(spark):
    schema = Schema.parse({"entities": [entity("a", ["id", "k"]), entity("b", ["id", "k"])], "relations": [relation("ab", "a.k", "b.k", "many_to_many", "inner")]})
    frame = spark.createDataFrame([(1, None), (2, 5)], "id long, k long")
    c = Catalog.from_frames(spark, schema, {"a": frame, "b": frame})
    assert execute(c, q("a", relations=["ab"])).count() == 1
    assert execute(c, q("a", relations=["ab"]), Options(null_equal=True)).count() == 2


def test_text_of_results(shop, spark):
    assert serialize(compile_request(shop, q("order", filters=where("id", "=", 101), select=[{"expr": "id"}, {"expr": "status", "alias": "s"}]))) == "id=101 | s=shipped"
    assert serialize(compile_request(shop, q("order", filters=where("id", "=", 0)))) == "(empty result)"
    assert serialize(compile_request(shop, q("order", aggregations=[{"field": "id", "agg": "count", "alias": "n"}]))) == "Aggregations: n=3"
    many = Catalog.from_frames(spark, Schema.parse({"entities": [entity("n", ["id"])]}), {"n": spark.range(15)})
    assert serialize(compile_request(many, q("n"))).endswith("... trimmed 5 rows ...")


def test_plans_push_down_and_prune(spark, tmp_path):
    path = str(tmp_path)
    spark.range(100).selectExpr("id", "id % 7 as k", "cast(id as string) as wide").write.parquet(f"{path}/a.parquet")
    spark.range(7).selectExpr("id as k", "cast(id as string) as name", "id as unused").write.parquet(f"{path}/b.parquet")
    schema = Schema.parse({"entities": [{**entity("a", ["id", "k", "wide"]), "source": "a.parquet"}, {**entity("b", ["k", "name", "unused"], "k"), "source": "b.parquet"}], "relations": [relation("ab", "a.k", "b.k")]})
    df = execute(Catalog.from_schema(spark, schema, "parquet", data_dir=path), q("a", relations=["ab"], limit=None, filters=where("b.k", "=", 3), group_by=[{"field": "b.name"}]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan and "wide" not in plan and "unused" not in plan
    assert [tuple(r) for r in df.collect()] == [("3", 14)]


def test_offset_on_root_rows(blocks):
    run = lambda **o: sorted((r["name"] or "-") + (r["system__code"] or "-") for r in execute(blocks, q("block", relations=["bs_left"], offset=1), Options(**o)).collect())
    assert run(offset_on_root=True) == ["BS3", "C-"] and len(run()) == 3
    with pytest.raises(ValueError, match="Unknown entity"):
        execute(blocks, q("block", relations=["bs_left"], filters=where("code", "=", "S1", "system")), Options(offset_on_root=True))
