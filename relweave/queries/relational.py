"""Registered selector queries: one or more for every operator of the query language, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.plans.cardinality import violating_keys
from relweave.plans.compiler import Options, compile_request, execute
from relweave.plans.scope import quoted
from relweave.plans.shape import nested
from relweave.queries.schemas import CORPUS, SHOP, SUPPLY, catalog, federated
from relweave.semantic.base import SemanticBackend
from relweave.semantic.build import build_semantic
from relweave.semantic.dense import top_k as dense_top_k
from relweave.sources.catalog import Catalog, Schema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None, run: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def selector(name: str, sql: str, which: dict = SUPPLY, options: Options | None = None, rounded: tuple[str, ...] = (), **request) -> None:
    """A query over the whole tables; ``rounded``: float results whose order of addition may differ."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = execute(catalog(spark, sf, which), {"op": "query", "limit": None, **request}, options)
        return df.select(*[F.round(quoted(c), 2).alias(c) if c in rounded else F.col(quoted(c)) for c in df.columns])

    add(name, sql, run)


def where(field: str, op: str, value, entity: str | None = None) -> dict:
    return {"type": "comparison", "field": field, "op": op, "value": value, "entity": entity}


def names(which: dict, entity: str, alias: str, label: str | None = None) -> str:
    cols = next(e["columns"] for e in which["entities"] if e["name"] == entity)
    return ", ".join(f'{alias}.{c["name"]}' + (f' as "{label}__{c["name"]}"' if label else "") for c in cols)


# --- projection -------------------------------------------------------------------------------------------------

selector("scan_default_select", "select * from nation", root_entity="nation")
selector("project_alias", "select c_custkey as id, c_name as nm from customer", root_entity="customer", select=[{"expr": "c_custkey", "alias": "id"}, {"expr": "customer.c_name", "alias": "nm"}])
selector("project_same_col_twice", "select c_name as a, c_name as b from customer", root_entity="customer", select=[{"expr": "c_name", "alias": "a"}, {"expr": "c_name", "alias": "b"}])
selector(
    "project_related",
    'select o_orderkey, c_name as "customer__c_name", c_acctbal as bal from orders left join customer on o_custkey = c_custkey',
    root_entity="orders",
    relations=["orders_customer"],
    select=[{"expr": "o_orderkey"}, {"expr": "customer.c_name"}, {"expr": "orders_customer.c_acctbal", "alias": "bal"}],
)

# --- filters ----------------------------------------------------------------------------------------------------

_ORDER = [{"expr": "o_orderkey"}, {"expr": "o_totalprice"}]
for _name, _op, _value in (("eq", "=", 1000), ("ne", "!=", 1000), ("gt", ">", 1000), ("lt", "<", 1000), ("ge", ">=", 1000), ("le", "<=", 1000)):
    selector(f"filter_cmp_{_name}", f"select o_orderkey, o_totalprice from orders where o_orderkey {_op} {_value}", root_entity="orders", select=_ORDER, filters=where("o_orderkey", _op, _value))
selector("filter_cmp_text_number", "select o_orderkey, o_totalprice from orders where o_totalprice > 250000.5", root_entity="orders", select=_ORDER, filters=where("o_totalprice", ">", "250000.5"))
selector("filter_date", "select order_id from shop_orders where order_date >= date '2024-01-01'", SHOP, root_entity="shop_orders", select=[{"expr": "order_id"}], filters=where("order_date", ">=", "2024-01-01"))
_CUST = [{"expr": "c_custkey"}, {"expr": "c_name"}]
selector("filter_in", "select c_custkey, c_name from customer where c_nationkey in (1, 3, 5)", root_entity="customer", select=_CUST, filters=where("c_nationkey", "in", [1, 3, 5]))
selector("filter_not_in", "select c_custkey, c_name from customer where c_nationkey not in (1, 3, 5)", root_entity="customer", select=_CUST, filters=where("c_nationkey", "not_in", [1, 3, 5]))
selector("filter_not_in_nulls", "select order_id, channel from shop_orders where channel not in ('online')", SHOP, root_entity="shop_orders", select=[{"expr": "order_id"}, {"expr": "channel"}], case_sensitivity=True, filters=where("channel", "not_in", ["online"]))
selector("filter_in_empty", "select c_custkey, c_name from customer where false", root_entity="customer", select=_CUST, filters=where("c_nationkey", "in", []))
selector("filter_not_in_empty", "select c_custkey, c_name from customer", root_entity="customer", select=_CUST, filters=where("c_nationkey", "not_in", []))
selector("filter_like_strict", "select c_custkey, c_name from customer where contains(c_name, '#0000001')", root_entity="customer", select=_CUST, case_sensitivity=True, filters=where("c_name", "like", "#0000001"))
selector("filter_ilike_strict", "select c_custkey, c_name from customer where contains(lower(c_name), 'er#0000001')", root_entity="customer", select=_CUST, case_sensitivity=True, filters=where("c_name", "ilike", "ER#0000001"))
selector("filter_like_literal_percent", "select doc_id from documents where contains(text, '%')", CORPUS, root_entity="documents", select=[{"expr": "doc_id"}], case_sensitivity=True, filters=where("text", "like", "%"))
_PART = [{"expr": "p_partkey"}, {"expr": "p_type"}]
selector("filter_soft_eq", "select p_partkey, p_type from part where lower(trim(p_type)) = 'economy'", root_entity="part", select=_PART, filters=where("p_type", "=", "  ecoNomy "))
selector("filter_soft_ne", "select p_partkey, p_type from part where lower(trim(p_type)) <> 'economy'", root_entity="part", select=_PART, filters=where("p_type", "!=", "ECONOMY"))
selector("filter_soft_in", "select p_partkey, p_type from part where lower(p_type) in ('economy', 'small')", root_entity="part", select=_PART, filters=where("p_type", "in", ["Economy", " SMALL"]))
selector("filter_soft_not_in", "select p_partkey, p_type from part where lower(p_type) not in ('economy', 'small')", root_entity="part", select=_PART, filters=where("p_type", "not_in", ["Economy", " SMALL"]))
selector("filter_soft_like", "select p_partkey, p_name from part where contains(lower(p_name), 'red wid')", root_entity="part", select=[{"expr": "p_partkey"}, {"expr": "p_name"}], filters=where("p_name", "like", "Red  Wid"))
selector("filter_soft_like_list", "select p_partkey, p_name from part where contains(lower(p_name), 'gizmo')", root_entity="part", select=[{"expr": "p_partkey"}, {"expr": "p_name"}], filters=where("p_name", "like", ["GIZMO", "widget"]))
_SPACE = r"[\s\p{Z}\x{85}]+"
_NORM = rf"lower(regexp_replace(regexp_replace(category, '^{_SPACE}|{_SPACE}$', '', 'g'), '{_SPACE}', ' ', 'g'))"
selector("filter_soft_spelling", f"select product_id, category from products where {_NORM} = 'kitchenware'", SHOP, root_entity="products", select=[{"expr": "product_id"}, {"expr": "category"}], filters=where("category", "=", "KITCHENWARE"))
selector(
    "filter_soft_eq_contains", "select p_partkey, p_name from part where contains(lower(p_name), 'widget')", options=Options(tolerance="contains"), root_entity="part", select=[{"expr": "p_partkey"}, {"expr": "p_name"}], filters=where("p_name", "=", "WIDGET")
)
selector(
    "filter_soft_ne_contains", "select p_partkey, p_name from part where not contains(lower(p_name), 'widget')", options=Options(tolerance="contains"), root_entity="part", select=[{"expr": "p_partkey"}, {"expr": "p_name"}], filters=where("p_name", "!=", "WIDGET")
)
add(
    "filter_soft_eq_ratcliff",
    # of all names only this one has a similarity of 0.85 or more; SQL has no such function
    "select p_partkey, p_name from part where lower(p_name) = 'red widget'",
    lambda spark, sf: execute(
        catalog(spark, sf), {"op": "query", "root_entity": "part", "limit": None, "select": [{"expr": "p_partkey"}, {"expr": "p_name"}], "filters": where("p_name", "=", "red widgt")}, Options(tolerance="ratcliff")
    ),
)
selector(
    "filter_tree_or_and",
    "select o_orderkey, o_totalprice from orders left join customer on o_custkey = c_custkey where o_totalprice > 300000 or (o_orderstatus = 'F' and c_mktsegment = 'BUILDING' and o_orderkey < 2000)",
    root_entity="orders",
    relations=["orders_customer"],
    select=_ORDER,
    case_sensitivity=True,
    filters={"type": "logical", "op": "or", "clauses": [where("o_totalprice", ">", 300000), {"type": "logical", "op": "and", "clauses": [where("o_orderstatus", "=", "F"), where("customer.c_mktsegment", "=", "BUILDING"), where("o_orderkey", "<", 2000), {"type": "logical", "op": "or", "clauses": []}]}]},
)
selector(
    "filter_relation_key",
    "select o_orderkey, o_totalprice from orders left join customer on o_custkey = c_custkey where c_acctbal < 0",
    root_entity="orders",
    relations=["orders_customer"],
    select=_ORDER,
    filters=where("c_acctbal", "<", 0, "orders_customer"),
)

# --- joins ------------------------------------------------------------------------------------------------------

for _join, _how in (("inner", "inner"), ("left", "left"), ("right", "right"), ("outer", "full outer")):
    selector(
        f"join_{_join}",
        f'select o.order_id, o.customer_id, c.customer_id as cid, c.name as "customers__name" from shop_orders o {_how} join customers c on o.customer_id = c.customer_id',
        SHOP,
        root_entity="shop_orders",
        relations=[f"shop_orders_{_join}"],
        select=[{"expr": "order_id"}, {"expr": "customer_id"}, {"expr": "customers.customer_id", "alias": "cid"}, {"expr": "customers.name"}],
    )
selector("join_default_select", f"select {names(SUPPLY, 'orders', 'o')}, {names(SUPPLY, 'customer', 'c', 'customer')} from orders o left join customer c on o_custkey = c_custkey", root_entity="orders", relations=["orders_customer"])
selector(
    "join_reverse_walk",
    'select c_custkey, o_orderkey as "orders__o_orderkey" from customer left join orders on o_custkey = c_custkey',
    root_entity="customer",
    relations=["orders_customer"],
    select=[{"expr": "c_custkey"}, {"expr": "orders.o_orderkey"}],
)
selector(
    "join_chain4",
    'select l_orderkey, l_linenumber, r_name as "region__r_name", n_name as "nation__n_name" from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey',
    root_entity="lineitem",
    relations=["lineitem_orders", "orders_customer", "customer_nation", "nation_region"],
    select=[{"expr": "l_orderkey"}, {"expr": "l_linenumber"}, {"expr": "region.r_name"}, {"expr": "nation.n_name"}],
)
selector("join_self", f"select {names(SUPPLY, 'nation', 'a')}, {names(SUPPLY, 'nation', 'b', 'nation_peer')} from nation a left join nation b on a.n_regionkey = b.n_nationkey", root_entity="nation", relations=["nation_peer"])
selector(
    "join_repeated_entity",
    'select l_orderkey, l_linenumber, a.n_name as "customer_nation__n_name", b.n_name as "supplier_nation__n_name" from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey left join supplier on l_suppkey = s_suppkey left join nation a on c_nationkey = a.n_nationkey left join nation b on s_nationkey = b.n_nationkey',
    root_entity="lineitem",
    relations=["lineitem_orders", "orders_customer", "lineitem_supplier", "customer_nation", "supplier_nation"],
    select=[{"expr": "l_orderkey"}, {"expr": "l_linenumber"}, {"expr": "customer_nation.n_name"}, {"expr": "supplier_nation.n_name"}],
)


def _channels(spark: SparkSession, sf: str) -> Catalog:
    orders = spark.read.parquet(f"{sf}/shop_orders.parquet")
    which = {"entities": [{"name": "o", "columns": [{"name": "order_id", "pk": True}, {"name": "channel"}]}, {"name": "ch", "columns": [{"name": "channel"}, {"name": "label"}]}], "relations": [{"name": "o_ch", "from_entity": "o", "from_column": "channel", "to_entity": "ch", "to_column": "channel"}]}
    labels = orders.select("channel").distinct().withColumn("label", F.coalesce("channel", F.lit("none")))
    return Catalog.from_frames(spark, Schema.parse(which), {"o": orders, "ch": labels})


for _suffix, _equal in (("equal", True), ("sql", False)):
    add(
        f"join_null_{_suffix}",
        f"with ch as (select distinct channel, coalesce(channel, 'none') label from shop_orders) select o.order_id, label as \"ch__label\" from shop_orders o left join ch on o.channel {'is not distinct from' if _equal else '='} ch.channel",
        lambda spark, sf, equal=_equal: execute(_channels(spark, sf), {"op": "query", "root_entity": "o", "relations": ["o_ch"], "limit": None, "select": [{"expr": "order_id"}, {"expr": "ch.label"}]}, Options(null_equal=equal)),
    )
add(
    "join_cardinality_report",
    "select customer_id as key, count(*) as n_rows from shop_orders where customer_id in (select customer_id from customers) group by 1 having count(*) > 1",
    lambda spark, sf: violating_keys(catalog(spark, sf, SHOP), "customer_record"),
)

# --- several sources --------------------------------------------------------------------------------------------


def over_sources(name: str, sql: str, **request) -> None:
    add(name, sql, lambda spark, sf: execute(federated(spark, sf), {"op": "query", "limit": None, **request}))


_PAIR = {"root_entity": "shop_orders", "select": [{"expr": "order_id"}, {"expr": "customers.city"}]}
for _join in ("inner", "left"):
    over_sources(f"federated_{_join}", f'select o.order_id, c.city as "customers__city" from shop_orders o {_join} join customers c on o.customer_id = c.customer_id', relations=[f"shop_orders_{_join}"], **_PAIR)
over_sources(
    "federated_groupby_remote",
    "select o.status, count(c.customer_id) as n from shop_orders o left join customers c on o.customer_id = c.customer_id group by 1",
    root_entity="shop_orders",
    relations=["shop_orders_left"],
    group_by=[{"field": "status"}],
    aggregations=[{"field": "customers.customer_id", "agg": "count", "alias": "n"}],
)
over_sources(
    "federated_groupby_remote_field",
    'select c.segment as "customers__segment", count(o.order_id) as n from shop_orders o left join customers c on o.customer_id = c.customer_id group by 1',
    root_entity="shop_orders",
    relations=["shop_orders_left"],
    group_by=[{"field": "customers.segment"}],
    aggregations=[{"field": "order_id", "agg": "count", "alias": "n"}],
)
over_sources(
    "federated_default_count",
    "select o.status, count(*) as count from shop_orders o left join customers c on o.customer_id = c.customer_id group by 1",
    root_entity="shop_orders",
    relations=["shop_orders_left"],
    group_by=[{"field": "status"}],
)
over_sources(
    "federated_global",
    "select count(c.customer_id) as n, cast(sum(o.order_id) as bigint) as s from shop_orders o left join customers c on o.customer_id = c.customer_id",
    root_entity="shop_orders",
    relations=["shop_orders_left"],
    aggregations=[{"field": "customers.customer_id", "agg": "count", "alias": "n"}, {"field": "order_id", "agg": "sum", "alias": "s"}],
)

add(
    "federated_offset_root",
    'select o.order_id, c.city as "customers__city" from (select * from shop_orders where order_id > 2000 order by order_id offset 3000) o left join customers c on o.customer_id = c.customer_id',
    lambda spark, sf: execute(federated(spark, sf), {"op": "query", "limit": None, "offset": 3000, "relations": ["shop_orders_left"], "filters": where("order_id", ">", 2000), **_PAIR}, Options(offset_on_root=True)),
)

# --- paging -----------------------------------------------------------------------------------------------------

selector("offset_limit", "select c_custkey, c_name from customer order by c_custkey limit 20 offset 40", root_entity="customer", select=_CUST, limit=20, offset=40)
selector("offset_no_limit", "select c_custkey, c_name from customer order by c_custkey offset 40", root_entity="customer", select=_CUST, offset=40)
add(
    "default_limit",
    "select least(count(*), 1000) as n_rows, least(count(*), 1000) as n_keys from customer",
    lambda spark, sf: execute(catalog(spark, sf), {"op": "query", "root_entity": "customer", "select": [{"expr": "c_custkey"}]}).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("c_custkey").alias("n_keys")),
)
selector("offset_far", "select o_orderkey, o_custkey from orders order by o_custkey desc limit 0", root_entity="orders", select=[{"expr": "o_orderkey"}, {"expr": "o_custkey"}], offset=10**9)
selector(
    "offset_groups", "select o_custkey, count(*) as count from orders group by 1 order by 1 offset 100", root_entity="orders", group_by=[{"field": "o_custkey"}], offset=100
)

# --- aggregation ------------------------------------------------------------------------------------------------

for _agg, _expr in (
    ("count", "count(total_amount)"),
    ("count_distinct", "count(distinct total_amount)"),
    ("sum", "round(sum(total_amount), 2)"),
    ("min", "round(min(total_amount), 2)"),
    ("max", "round(max(total_amount), 2)"),
    ("avg", "round(avg(total_amount), 2)"),
    ("median", "round(quantile_cont(total_amount, 0.5), 2)"),
    ("std", "round(stddev_samp(total_amount), 2)"),
    ("var", "round(var_samp(total_amount), 2)"),
    ("size", "count(*)"),
    ("quantile", "round(quantile_cont(total_amount, 0.5), 2)"),
    ("sem", "round(stddev_samp(total_amount) / sqrt(count(total_amount)), 2)"),
    ("skew", "round(skewness(total_amount), 2)"),
    ("kurtosis", "round(kurtosis_pop(total_amount), 2)"),
):
    selector(f"agg_{_agg}", f"select {_expr} as v from shop_orders", SHOP, rounded=() if _agg in ("count", "count_distinct", "size") else ("v",), root_entity="shop_orders", aggregations=[{"field": "total_amount", "agg": _agg, "alias": "v"}])
selector("agg_any_value", "select o_orderkey, o_custkey as v from orders", root_entity="orders", group_by=[{"field": "o_orderkey"}], aggregations=[{"field": "o_custkey", "agg": "any_value", "alias": "v"}])
selector("agg_mode", "select channel as v from shop_orders where channel is not null group by 1 order by count(*) desc, 1 limit 1", SHOP, root_entity="shop_orders", aggregations=[{"field": "channel", "agg": "mode", "alias": "v"}])
_REV = [{"field": "o_totalprice", "agg": "sum", "alias": "revenue"}, {"field": "o_orderkey", "agg": "count", "alias": "n"}]
selector("group_one", "select o_orderstatus, round(sum(o_totalprice), 2) as revenue, count(o_orderkey) as n from orders group by 1", rounded=("revenue",), root_entity="orders", group_by=[{"field": "o_orderstatus"}], aggregations=_REV)
selector("group_two", "select o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) as revenue, count(o_orderkey) as n from orders group by 1, 2", rounded=("revenue",), root_entity="orders", group_by=[{"field": "o_orderstatus"}, {"field": "o_orderpriority"}], aggregations=_REV)
selector(
    "group_joined",
    'select c_mktsegment as "customer__c_mktsegment", round(sum(o_totalprice), 2) as revenue, count(o_orderkey) as n from orders left join customer on o_custkey = c_custkey where o_orderstatus = \'F\' group by 1',
    rounded=("revenue",),
    root_entity="orders",
    relations=["orders_customer"],
    case_sensitivity=True,
    filters=where("o_orderstatus", "=", "F"),
    group_by=[{"entity": "customer", "field": "c_mktsegment"}],
    aggregations=_REV,
)
selector("group_null_key", "select channel, count(order_id) as n from shop_orders group by 1", SHOP, root_entity="shop_orders", group_by=[{"field": "channel"}], aggregations=[{"field": "order_id", "agg": "count", "alias": "n"}])
selector("group_default_count", "select event_type, count(*) as count from events group by 1", root_entity="events", group_by=[{"field": "event_type"}])
selector("group_alias", 'select event_type as kind, count(value) as count_value from events group by 1', root_entity="events", group_by=[{"field": "event_type", "alias": "kind"}], aggregations=[{"field": "value", "agg": "count"}])
selector(
    "group_limit_offset", "select c_nationkey, count(*) as count from customer group by 1 order by 1 limit 5 offset 3", root_entity="customer", group_by=[{"field": "c_nationkey"}], limit=5, offset=3
)
selector("global_agg_ignores_limit", "select count(c_custkey) as count_c_custkey from customer", root_entity="customer", aggregations=[{"field": "c_custkey", "agg": "count"}], limit=0, offset=5)
selector("agg_joined_field", 'select max(r_name) as "max_region.r_name" from nation left join region on n_regionkey = r_regionkey', root_entity="nation", relations=["nation_region"], aggregations=[{"field": "region.r_name", "agg": "max"}])
selector("agg_empty", "select sum(o_totalprice) as s, count(o_orderkey) as n, max(o_orderkey) as m from orders where o_orderkey < 0", root_entity="orders", filters=where("o_orderkey", "<", 0), aggregations=[{"field": "o_totalprice", "agg": "sum", "alias": "s"}, {"field": "o_orderkey", "agg": "count", "alias": "n"}, {"field": "o_orderkey", "agg": "max", "alias": "m"}])

# --- semantic search --------------------------------------------------------------------------------------------


def _tfidf(table: str, key: str, fields: tuple[str, ...], query: str, synonyms: bool = True) -> str:
    """CTEs: ``w`` (postings), ``q`` (query weights)."""
    word = "case when t in ('widget','widgets','gizmo','gizmos') then 'gadget' else t end" if synonyms else "t"
    parts = " union all ".join(f"select {key} id, '{f}' field, unnest(regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{N}}_]+')) t from {table}" for f in fields)
    return f"""with t0 as ({parts}), tok as (select id, field, {word} t from t0),
 idf as (select t, ln((1.0 + (select count(*) from {table})) / (1.0 + count(distinct id))) + 1.0 idf from tok group by t),
 a as (select * from tok union all select id, '__all__', t from tok),
 x as (select id, field, a.t, count(*) * any_value(idf) x from a join idf using (t) group by all),
 w as (select id, field, t, x / sqrt(sum(x * x) over (partition by id, field)) w from x),
 q1 as (select {word} t from (select unnest(regexp_extract_all(lower('{query}'), '[\\p{{L}}\\p{{N}}_]+')) t)),
 q0 as (select t, count(*) * any_value(idf) x from q1 join idf using (t) group by t),
 q as (select t, x / sqrt((select sum(x * x) from q0)) qw from q0)"""


def _scores(fields: str, k: int) -> str:
    return f"select id, sum(qw * w) score from w join q using (t) where field in ({fields}) group by 1 having sum(qw * w) > 0 order by round(sum(qw * w), 12) desc, id limit {k}"


def _index(spark: SparkSession, sf: str, table: str, which: dict = SUPPLY) -> SemanticBackend:
    return build_semantic(catalog(spark, sf, which), only=[table])


def _with_semantic(spark: SparkSession, sf: str) -> Catalog:
    c = catalog(spark, sf)
    c.semantic = _index(spark, sf, "part")
    return c


def search(name: str, table: str, key: str, indexed: tuple[str, ...], fields: list[str], query: str, k: int, which: dict = SUPPLY) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = catalog(spark, sf, which)
        c.semantic = _index(spark, sf, table, which)
        found = execute(c, {"op": "semantic_only", "entity": table, "fields": fields, "query": query, "top_k": k})
        return found.select("id", F.round("score", 9).alias("score"))

    asked = ", ".join(f"'{f}'" for f in fields or ["__all__"])
    add(name, f"{_tfidf(table, key, indexed, query)} select id, round(score, 9) as score from ({_scores(asked, k)})", run)


_NAMES = ("p_name", "p_type")
search("tfidf_search", "part", "p_partkey", _NAMES, [], "red gizmo economy", 50)
search("tfidf_field_sum", "part", "p_partkey", _NAMES, ["p_name", "p_type"], "red gizmo economy", 50)
search("tfidf_synonym", "part", "p_partkey", _NAMES, ["p_name"], "Widgets unknownword", 30)
search("tfidf_no_match", "part", "p_partkey", _NAMES, [], "nosuchword", 30)
search("tfidf_documents", "documents", "doc_id", ("text",), [], "journal harbour привет 角", 40, CORPUS)

_PARTQ = _tfidf("part", "p_partkey", _NAMES, "red gizmo economy")


def clauses(name: str, sql: str, *parts: dict, root: str = "part", relations: tuple[str, ...] = (), **request) -> None:
    add(name, sql, lambda spark, sf: execute(_with_semantic(spark, sf), {"op": "query", "root_entity": root, "relations": list(relations), "limit": None, "semantic_clauses": list(parts), **request}))


_CLAUSE = {"entity": "part", "query": "red gizmo economy", "top_k": 60}
_KEYS = [{"expr": "p_partkey"}]
clauses("semantic_filter", f"{_PARTQ} select id as p_partkey from ({_scores(chr(39) + '__all__' + chr(39), 60)})", _CLAUSE, select=_KEYS)
clauses("semantic_filter_limit", f"{_PARTQ} select id as p_partkey from ({_scores(chr(39) + '__all__' + chr(39), 60)}) limit 7", _CLAUSE, select=_KEYS, limit=7)
clauses(
    "semantic_boost",
    f"{_PARTQ}, m as ({_scores(chr(39) + '__all__' + chr(39), 60)}) select p_partkey from part left join m on id = p_partkey order by round(coalesce(score, 0), 12) desc, p_partkey limit 100",
    {**_CLAUSE, "mode": "boost"},
    select=_KEYS,
    limit=100,
)
clauses("semantic_threshold", f"{_PARTQ} select id as p_partkey from ({_scores(chr(39) + '__all__' + chr(39), 60)}) where score >= 0.7", {**_CLAUSE, "threshold": 0.7}, select=_KEYS)
clauses(
    "semantic_multi",
    f"{_PARTQ}, m as ({_scores(chr(39) + '__all__' + chr(39), 60)}), m2 as ({_scores(chr(39) + 'p_type' + chr(39), 500)}) select p_partkey from part join m on m.id = p_partkey left join m2 on m2.id = p_partkey order by round(m.score + coalesce(m2.score, 0), 12) desc, p_partkey limit 25",
    _CLAUSE,
    {**_CLAUSE, "fields": ["p_type"], "top_k": 500, "mode": "boost"},
    select=_KEYS,
    limit=25,
)
clauses(
    "semantic_joined_entity",
    f"{_PARTQ}, m as ({_scores(chr(39) + '__all__' + chr(39), 60)}) select l_orderkey, l_linenumber from lineitem join m on id = l_partkey",
    _CLAUSE,
    root="lineitem",
    relations=("lineitem_part",),
    select=[{"expr": "l_orderkey"}, {"expr": "l_linenumber"}],
)
clauses(
    "semantic_group_order",
    f"{_PARTQ}, m as ({_scores(chr(39) + '__all__' + chr(39), 300)}) select p_brand, count(p_partkey) as n from part join m on id = p_partkey group by 1 order by sum(score) desc, 1 limit 4",
    {**_CLAUSE, "top_k": 300},
    group_by=[{"field": "p_brand"}],
    aggregations=[{"field": "p_partkey", "agg": "count", "alias": "n"}],
    limit=4,
)


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.filter("vec_id = 0").select("embedding").first()[0]
    return dense_top_k(v, q, 25, "vec_id", "embedding").select("id", F.round("score", 6).alias("score"))


add(
    "dense_topk",
    "with q as (select embedding::double[] e from embeddings where vec_id = 0) select vec_id as id, round(list_dot_product(embedding::double[], e) / sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product(e, e)), 6) as score from embeddings, q order by round(list_dot_product(embedding::double[], e) / sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product(e, e)), 12) desc, vec_id limit 25",
    _dense,
)

# --- introspection and shape ------------------------------------------------------------------------------------


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "cast(null as varchar)" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return f"select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


_S = Schema.parse(SUPPLY)
_TYPES = "case when data_type like '%INT%' then 'int' when data_type = 'VARCHAR' then 'text' when data_type in ('DOUBLE', 'FLOAT') then 'float' when data_type like 'TIMESTAMP%' then 'timestamp' else lower(data_type) end"
add(
    "schema_entities",
    f"""select table_name as entity, cast(null as varchar) as label, column_name as "column", {_TYPES} as type,
 case when column_name in ('r_regionkey', 'c_custkey', 's_suppkey', 'p_partkey', 'o_orderkey', 'event_id') and table_name <> 'lineitem' or table_name || column_name = 'nationn_nationkey' then 'primary_key' end as role,
 column_name in ('p_name', 'p_type') as semantic
 from information_schema.columns where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')""",
    lambda spark, sf: execute(catalog(spark, sf), {"op": "schema"}),
)
add("schema_relations", _values([(r.name, r.from_entity, r.from_column, r.to_entity, r.to_column, r.cardinality, r.join) for r in _S.relations], 'relation, from_entity, from_column, to_entity, to_column, cardinality, "join"'), lambda spark, sf: catalog(spark, sf).relations_frame())


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    request = {"op": "query", "root_entity": "nation", "relations": ["nation_region"], "limit": None, "select": [{"expr": "n_name"}, {"expr": "region.r_name"}]}
    return nested(compile_request(catalog(spark, sf), request)).select("entity", F.col("data.n_name").alias("n_name"), F.col("related.region.r_name").alias("r_name"))


add("row_shape", "select 'nation' as entity, n_name, r_name from nation left join region on n_regionkey = r_regionkey", _nested)
add(
    "fk_violations",
    " union all ".join(
        f"select '{r['name']}' as relation, cast(a.{r['from_column']} as varchar) as key, count(*) as n_rows from {r['from_entity']} a where a.{r['from_column']} is not null and a.{r['from_column']} not in (select {r['to_column']} from {r['to_entity']} where {r['to_column']} is not null) group by 2"
        for r in SHOP["relations"]
    ),
    lambda spark, sf: catalog(spark, sf, SHOP).violations(),
)
