"""Queries of the general problems over the shop tables (p1, p3, p5)."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.operators.eager import eager_join_aggregate, with_field_total
from relweave.operators.orphans import find_orphans, hot_references, validity
from relweave.operators.rolling import rolling_totals
from relweave.operators.versions import cents, latest
from relweave.plans.materialize import materialize

START, FIRST, END = dt.date(2022, 1, 1), dt.date(2022, 1, 30), dt.date(2024, 5, 31)


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def key_states(spark: SparkSession, sf: str) -> DataFrame:
    """Per-key results of every product and customer, joined with the states of the parent's rows."""
    line = "cast(round(quantity * unit_price * 100) as long)"
    total = "case when isnan(total_amount) then null else cast(round(total_amount * 100) as long) end"
    items = eager_join_aggregate(_read(spark, sf, "order_items"), _read(spark, sf, "products"), "product_id", sums={"units": "quantity", "amount_cents": line}, right_sums={"right_total": "in_stock"})
    orders = eager_join_aggregate(_read(spark, sf, "shop_orders"), _read(spark, sf, "customers"), "customer_id", sums={"units": "cast(null as long)", "amount_cents": total}, right_sums={"right_total": "length(name)"})
    return items.withColumn("field", F.lit("order_items.product_id")).unionByName(orders.withColumn("field", F.lit("shop_orders.customer_id")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    # the compact states are written once, so that the roll-up doesn't scan the tables again
    states = with_field_total(materialize(key_states(spark, sf), "states"))
    return states.filter("key_value is not null and n_left * 100 >= n_field").select("field", "key_value")


def p1_key_totals(spark: SparkSession, sf: str) -> DataFrame:
    return key_states(spark, sf).select("field", "key_value", "n_left", "n_right", "n_joined", "units", "amount_cents", F.col("right_total").cast("long").alias("right_total"))


P1_FOUND = """
with r as (select 'order_items.product_id' as field, product_id as key_value from order_items
           union all select 'shop_orders.customer_id', customer_id from shop_orders)
select field, key_value from r join (select field, count(*) n from r group by field) using (field)
where key_value is not null group by field, key_value, n having count(*) * 100 >= n"""

P1_KEY_TOTALS = """
with i as (select product_id k, quantity q, cast(round(quantity * unit_price * 100) as bigint) c from order_items),
 o as (select customer_id k, cast(round(total_amount * 100) as bigint) c from shop_orders),
 jp as (select i.*, p.product_id m, p.in_stock r from i left join products p on p.product_id = i.k),
 jc as (select o.*, p.customer_id m, length(p.name) r from o left join customers p on p.customer_id = o.k),
 ni as (select k, count(*) n from i group by k), no as (select k, count(*) n from o group by k),
 gi as (select k, count(*) n_joined, count(m) hits, cast(sum(q) as bigint) units, cast(sum(c) as bigint) amount_cents, cast(sum(r) as bigint) right_total from jp group by k),
 go as (select k, count(*) n_joined, count(m) hits, cast(null as bigint) units, cast(sum(c) as bigint) amount_cents, cast(sum(r) as bigint) right_total from jc group by k)
select 'order_items.product_id' as field, g.k as key_value, n.n as n_left, cast(hits // n.n as bigint) as n_right, n_joined, units, amount_cents, right_total
from gi g join ni n on g.k is not distinct from n.k
union all select 'shop_orders.customer_id', g.k, n.n, cast(hits // n.n as bigint), n_joined, units, amount_cents, right_total
from go g join no n on g.k is not distinct from n.k"""


def orphans(spark: SparkSession, sf: str, ended: bool = False) -> DataFrame:
    """Each table is read once: what it refers to and when its keys arrived comes from one aggregate, written for both uses."""

    def first_seen(table: str, row: str, parents: tuple[str, ...] = ()) -> DataFrame:
        """Rows by their first arrival; a reference doesn't change between versions."""
        df = _read(spark, sf, table).filter(F.col(row).isNotNull())
        return df.groupBy(F.col(row).alias("row_id")).agg(F.min("loaded_at").alias("seen_at"), F.max("loaded_at").alias("last_at"), *[F.max(c).alias(c) for c in parents])

    def refs(seen: DataFrame, table: str, parents: dict[str, str]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(f"{table}.{c}").alias("field"), F.lit(p).alias("parent"), F.col(c).alias("key")) for c, p in parents.items()])
        return seen.select("row_id", "seen_at", F.inline(each)).select("field", "parent", "row_id", "key", "seen_at")

    items = materialize(first_seen("order_items", "order_item_id", ("order_id", "product_id")).drop("last_at"), "items")
    orders = materialize(first_seen("shop_orders", "order_id", ("customer_id",)), "orders")
    all_refs = refs(items, "order_items", {"order_id": "shop_orders", "product_id": "products"}).unionByName(refs(orders, "shop_orders", {"customer_id": "customers"}))
    rows = {"shop_orders": orders, "products": first_seen("products", "product_id"), "customers": first_seen("customers", "customer_id")}
    parents = reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("parent"), F.col("row_id").alias("key"), F.col("seen_at").alias("loaded_at"), "last_at") for t, df in rows.items()])
    deleted = _read(spark, sf, "deleted_keys").select(F.col("table_name").alias("parent"), F.col("key_value").alias("key"), "deleted_at")
    return find_orphans(all_refs, validity(parents, deleted), hot_references(all_refs), ended)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans(spark, sf)


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans by field, month and kind."""
    return orphans(spark, sf).groupBy("field", "period", "kind").agg(F.count(F.lit(1)).alias("n_rows"))


def p3_after_deletion(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans by the parents' intervals: references that were made after the parent's deletion too."""
    return orphans(spark, sf, ended=True)


P3_FOUND = """
with i as (select order_item_id row_id, min(loaded_at) seen, max(order_id) order_id, max(product_id) product_id from order_items group by 1),
 o as (select order_id row_id, min(loaded_at) seen, max(customer_id) customer_id from shop_orders group by 1),
 refs as (select 'order_items.order_id' field, 'shop_orders' t, row_id, order_id k, seen from i
          union all select 'order_items.product_id', 'products', row_id, product_id, seen from i
          union all select 'shop_orders.customer_id', 'customers', row_id, customer_id, seen from o),
 parents as (select 'shop_orders' t, order_id k, min(loaded_at) since from shop_orders group by 2
             union all select 'products', product_id, min(loaded_at) from products group by 2
             union all select 'customers', customer_id, min(loaded_at) from customers group by 2),
 gone as (select distinct table_name t, key_value k from deleted_keys)
select field, strftime(seen, '%Y-%m') as period,
 case when since > seen then 'late' when gone.k is not null then 'deleted' else 'missing' end as kind, row_id
from refs left join parents using (t, k) left join gone using (t, k)
where refs.k is not null and (since is null or since > seen)"""

P3_AFTER_DELETION = P3_FOUND.replace("min(loaded_at) since", "min(loaded_at) since, max(loaded_at) last").replace("min(loaded_at) from", "min(loaded_at), max(loaded_at) from").replace(
    "select distinct table_name t, key_value k from deleted_keys", "select table_name t, key_value k, max(deleted_at) deleted_at from deleted_keys group by 1, 2"
).replace("since is null or since > seen)", "since is null or since > seen or (deleted_at >= last and deleted_at <= seen))")

P3_REPORT = f"select field, period, kind, count(*) as n_rows from ({P3_FOUND}) group by 1, 2, 3"


def daily_totals(spark: SparkSession, sf: str) -> DataFrame:
    valid = latest(_read(spark, sf, "shop_orders"), "order_id", "loaded_at", ["customer_id", "order_date", "total_amount"])
    return rolling_totals(valid.withColumn("cents", cents(F.col("total_amount"))), "customer_id", "order_date", "cents", START, END)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    days = daily_totals(spark, sf).filter((F.col("order_date") >= F.lit(FIRST)) & (F.col("total_7") >= 400_000) & (10 * F.col("total_7") >= 7 * F.col("total_30")))
    return days.select("customer_id", F.date_format("order_date", "yyyy-MM-dd").alias("day"))


def p5_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's largest trailing totals and how many days have any."""
    return daily_totals(spark, sf).groupBy("customer_id").agg(F.max("total_7").alias("max_7"), F.max("total_30").alias("max_30"), F.count_if(F.col("total_30") != 0).alias("active_days"))


_P5 = """
with v as (select customer_id, order_date, total_amount from (select *, row_number() over (partition by order_id order by loaded_at desc) rn from shop_orders) where rn = 1),
 d as (select customer_id c, order_date d, cast(sum(coalesce(cast(round(total_amount * 100) as bigint), 0)) as bigint) a from v
       where customer_id is not null and order_date between date '2022-01-01' and date '2024-05-31' group by 1, 2),
 cal as (select cast(unnest(generate_series(date '2022-01-01', date '2024-05-31', interval 1 day)) as date) d),
 dense as (select c, cal.d, coalesce(a, 0) a from (select distinct c from d) cross join cal left join d using (c, d)),
 t as (select c, d, sum(a) over (partition by c order by d rows between 6 preceding and current row) t7,
              sum(a) over (partition by c order by d rows between 29 preceding and current row) t30 from dense)
"""
P5_FOUND = _P5 + "select c as customer_id, strftime(d, '%Y-%m-%d') as day from t where d >= date '2022-01-30' and t7 >= 400000 and 10 * t7 >= 7 * t30"
P5_PEAKS = _P5 + "select c as customer_id, cast(max(t7) as bigint) as max_7, cast(max(t30) as bigint) as max_30, count(*) filter (t30 <> 0) as active_days from t group by 1"

QUERIES = {"p1_found": p1_found, "p1_key_totals": p1_key_totals, "p3_found": p3_found, "p3_report": p3_report, "p3_after_deletion": p3_after_deletion, "p5_found": p5_found, "p5_peaks": p5_peaks}
SQL = {"p1_found": P1_FOUND, "p1_key_totals": P1_KEY_TOTALS, "p3_found": P3_FOUND, "p3_report": P3_REPORT, "p3_after_deletion": P3_AFTER_DELETION, "p5_found": P5_FOUND, "p5_peaks": P5_PEAKS}
