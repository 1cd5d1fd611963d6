"""Schemas of the test tables: the order and supply tables, the shop, and two tables of text and vectors."""

from __future__ import annotations

from pyspark.sql import SparkSession

from relweave.sources.catalog import Catalog, Schema


def _entity(name: str, columns: str, key: str | None, semantic: tuple[str, ...] = ()) -> dict:
    parts = [c.split(":") for c in columns.split()]
    return {
        "name": name,
        "source": f"{name}.parquet",
        "columns": [{"name": n, "type": t, "pk": n == key, "semantic": n in semantic} for n, t in parts],
        "semantic_text_fields": list(semantic),
    }


def _relation(name: str, left: str, right: str, cardinality: str = "many_to_1", join: str = "left") -> dict:
    (a, x), (b, y) = left.split("."), right.split(".")
    return {"name": name, "from_entity": a, "from_column": x, "to_entity": b, "to_column": y, "cardinality": cardinality, "join": join}


SUPPLY = {
    "name": "supply",
    "description": "Orders of parts from suppliers",
    "entities": [
        _entity("region", "r_regionkey:int r_name:text", "r_regionkey"),
        _entity("nation", "n_nationkey:int n_name:text n_regionkey:int", "n_nationkey"),
        _entity("customer", "c_custkey:int c_name:text c_nationkey:int c_acctbal:float c_mktsegment:text", "c_custkey"),
        _entity("supplier", "s_suppkey:int s_name:text s_nationkey:int s_acctbal:float", "s_suppkey"),
        _entity("part", "p_partkey:int p_name:text p_brand:text p_type:text p_size:int p_retailprice:float", "p_partkey", ("p_name", "p_type")),
        _entity("orders", "o_orderkey:int o_custkey:int o_orderstatus:text o_totalprice:float o_orderdate:timestamp o_orderpriority:text", "o_orderkey"),
        _entity("lineitem", "l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_quantity:float l_extendedprice:float l_discount:float l_tax:float l_returnflag:text l_linestatus:text l_shipdate:timestamp", None),
        _entity("events", "event_id:int ts:timestamp user_id:int event_type:text value:float props:text", "event_id"),
    ],
    "relations": [
        _relation("orders_customer", "orders.o_custkey", "customer.c_custkey"),
        _relation("orders_customer_inner", "orders.o_custkey", "customer.c_custkey", join="inner"),
        _relation("lineitem_orders", "lineitem.l_orderkey", "orders.o_orderkey"),
        _relation("lineitem_part", "lineitem.l_partkey", "part.p_partkey"),
        _relation("lineitem_supplier", "lineitem.l_suppkey", "supplier.s_suppkey"),
        _relation("customer_nation", "customer.c_nationkey", "nation.n_nationkey"),
        _relation("supplier_nation", "supplier.s_nationkey", "nation.n_nationkey"),
        _relation("nation_region", "nation.n_regionkey", "region.r_regionkey"),
        _relation("nation_peer", "nation.n_regionkey", "nation.n_nationkey"),
        _relation("customer_events", "customer.c_custkey", "events.user_id", "1_to_many"),
    ],
}

SHOP = {
    "name": "shop",
    "description": "Orders of a retail store",
    "entities": [
        _entity("customers", "customer_id:int name:text email:text city:text segment:text signup_date:date loaded_at:timestamp", "customer_id"),
        _entity("products", "product_id:int name:text category:text price:float in_stock:int loaded_at:timestamp", "product_id", ("name", "category")),
        _entity("shop_orders", "order_id:int customer_id:int order_date:date status:text channel:text total_amount:float loaded_at:timestamp", "order_id"),
        _entity("order_items", "order_item_id:int order_id:int product_id:int quantity:int unit_price:float loaded_at:timestamp", "order_item_id"),
    ],
    "relations": [
        *[_relation(f"shop_orders_{j}", "shop_orders.customer_id", "customers.customer_id", join=j) for j in ("inner", "left", "right", "outer")],
        _relation("items_orders", "order_items.order_id", "shop_orders.order_id"),
        _relation("items_products", "order_items.product_id", "products.product_id"),
        _relation("customer_record", "customers.customer_id", "shop_orders.customer_id", "1_to_1", "inner"),
    ],
}

CORPUS = {
    "name": "corpus",
    "entities": [
        _entity("documents", "doc_id:int text:text lang:text target_text:text target_lang:text align_score:float source:text segment_no:int n_chars:int", "doc_id", ("text",)),
        _entity("embeddings", "vec_id:int embedding:array label:int", "vec_id"),
    ],
}


def catalog(spark: SparkSession, sf: str, which: dict = SUPPLY) -> Catalog:
    return Catalog.from_schema(spark, Schema.parse(which), "parquet", data_dir=sf)


def federated(spark: SparkSession, sf: str) -> Catalog:
    """The shop's orders and its customers as two sources."""
    parts = {}
    for name, own in (("sales", ("shop_orders", "order_items", "products")), ("accounts", ("customers",))):
        which = {"name": name, "entities": [e for e in SHOP["entities"] if e["name"] in own], "relations": SHOP["relations"] if name == "sales" else []}
        parts[name] = catalog(spark, sf, which)
    return Catalog.merge(parts)
