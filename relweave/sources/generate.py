"""Synthetic commerce tables, their integrity, and facts about tables and folders."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schema of what `commerce` makes, in CSV files.
SCHEMA = {
    "name": "commerce",
    "description": "Customers, products and orders of a made-up store",
    "entities": [
        {"name": n, "source": f"{n}.csv", "columns": [{"name": c, "type": t, "pk": i == 0} for i, (c, t) in enumerate(x.split(":") for x in columns.split())], "semantic_text_fields": list(text)}
        for n, columns, text in (
            ("customers", "customer_id:int name:text city:text segment:text signup_date:date", ("name", "city")),
            ("products", "product_id:int name:text category:text price:float in_stock:int", ("name", "category")),
            ("orders", "order_id:int customer_id:int order_date:date status:text channel:text order_total:float", ()),
            ("order_items", "order_item_id:int order_id:int product_id:int quantity:int unit_price:float line_total:float", ()),
        )
    ],
    "relations": [
        {"name": f"{a}_{b}", "from_entity": a, "from_column": c, "to_entity": b, "to_column": c}
        for a, c, b in (("orders", "customer_id", "customers"), ("order_items", "order_id", "orders"), ("order_items", "product_id", "products"))
    ],
}
CITIES = ("Northport", "Eastvale", "Southmere", "Westfield", "Lakeside")
SEGMENTS = ("consumer", "corporate", "public")
CATEGORIES = ("kitchen", "garden", "office", "travel", "sport")
#: Fixed values.
STATES = ("pending", "processing", "shipped", "delivered", "cancelled")
CHANNELS = ("web", "phone", "store")


def commerce(spark: SparkSession, rows: int = 1000, seed: int = 42) -> dict[str, DataFrame]:
    """``customers, products, orders, order_items``; an order's total is the rounded sum of its lines.

    Every value is drawn from the MD5 of seed, column and key (its first 15 hexadecimal digits), so the tables are the same whatever the
    number of partitions, and on any other engine.
    """

    def draw(salt: str, n: int, key: str = "id"):
        digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), F.col(key).cast("string"))), 1, 15)
        return F.conv(digits, 16, 10).cast("long") % n

    def pick(values: tuple[str, ...], salt: str):
        return F.element_at(F.array(*map(F.lit, values)), (draw(salt, len(values)) + 1).cast("int"))

    n_products = max(200, rows // 3)
    base = spark.range(1, rows + 1)
    customers = base.select(F.col("id").alias("customer_id"), F.concat(F.lit("Customer "), "id").alias("name"), pick(CITIES, "city").alias("city"), pick(SEGMENTS, "segment").alias("segment"), F.date_add(F.lit("2020-01-01").cast("date"), draw("signup", 1400).cast("int")).alias("signup_date"))
    products = spark.range(1, n_products + 1).select(F.col("id").alias("product_id"), F.concat(F.lit("Product "), "id").alias("name"), pick(CATEGORIES, "category").alias("category"), ((draw("price", 49500) + 500) / 100).alias("price"), draw("stock", 500).alias("in_stock"))
    heads = base.select(F.col("id").alias("order_id"), (draw("buyer", rows) + 1).alias("customer_id"), F.date_add(F.lit("2023-01-01").cast("date"), draw("day", 730).cast("int")).alias("order_date"), pick(STATES, "status").alias("status"), pick(CHANNELS, "channel").alias("channel"))
    lines = base.select(F.col("id").alias("order_id"), F.explode(F.sequence(F.lit(1), (draw("lines", 5) + 1).cast("int"))).alias("line")).withColumn("id", F.col("order_id") * 5 + F.col("line") - 5)
    lines = lines.select(F.col("id").alias("order_item_id"), "order_id", (draw("product", n_products) + 1).alias("product_id"), (draw("quantity", 4) + 1).alias("quantity"))
    items = lines.join(products.select("product_id", F.col("price").alias("unit_price")), "product_id").withColumn("line_total", F.round(F.col("quantity") * F.col("unit_price"), 2))
    items = items.select("order_item_id", "order_id", "product_id", "quantity", "unit_price", "line_total")
    totals = items.groupBy("order_id").agg(F.round(F.sum("line_total"), 2).alias("order_total"))
    return {"customers": customers, "products": products, "orders": heads.join(totals, "order_id"), "order_items": items}


def check_commerce(t: dict[str, DataFrame], rows: int) -> None:
    """Row counts and foreign keys; `ValueError` where something is lost."""
    for name in ("customers", "orders"):
        if (n := t[name].count()) != rows:
            raise ValueError(f"{name} has {n} rows, not {rows}")
    for child, key, parent in (("orders", "customer_id", "customers"), ("order_items", "order_id", "orders"), ("order_items", "product_id", "products")):
        if not t[child].join(t[parent], key, "left_anti").isEmpty():
            raise ValueError(f"{child}.{key} has values that {parent} lacks")


def order_stats(orders: DataFrame, date_col: str, by: str) -> DataFrame:
    """``value, n_rows, first, last`` of each value of a column."""
    return orders.groupBy(F.col(by).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(date_col).alias("first"), F.max(date_col).alias("last"))


def write_csv(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def save_tables(tables: dict[str, DataFrame], database: str | None = None) -> None:
    """As tables of the session's catalog."""
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}" if database else name)


def fingerprint(folder: str | Path) -> dict[str, object]:
    """Hash, number and bytes of the files below a local folder, by path, size and time; without run and cache folders."""
    root, digest, n, size = Path(folder), hashlib.sha256(), 0, 0
    for path in sorted(p for p in root.rglob("*") if p.is_file()):
        rel = path.relative_to(root)
        if rel.parts[0] not in (".runs", ".cache"):
            stat = path.stat()
            digest.update(json.dumps([str(rel), stat.st_size, stat.st_mtime]).encode())
            n, size = n + 1, size + stat.st_size
    return {"hash": digest.hexdigest(), "files_count": n, "bytes_total": size}


def fingerprint_distributed(spark: SparkSession, folder: str) -> DataFrame:
    """The same facts of a folder on any file system, from the files' metadata only: ``hash, files_count, bytes_total``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    files = files.filter(~F.col("path").rlike(r"/\.(runs|cache)/"))
    each = F.sha2(F.concat_ws("|", "path", "length", "at"), 256)
    # the sorted hashes of files are far smaller than the files, and are hashed once more
    return files.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list(each))), 256).alias("hash"), F.count(F.lit(1)).alias("files_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_total"))
