"""Queries of the problems tagged llm (p2, p4, p6, p7, p8) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm.leak import drop_leaked, find_leaks
from relweave.llm.pairs import cooccurring
from relweave.llm.spans import shared_amounts, shared_spans
from relweave.llm.sql import P2_FOUND, P2_PAIRS, P4_FOUND, P6_ROUNDTRIP, P8_AMOUNTS, P8_FOUND
from relweave.llm.tokens import decode_corpus, encode_corpus
from relweave.llm.topn import top_n
from relweave.operators.versions import latest


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cooccurring(_read(spark, sf, "order_items"), "order_id", "product_id", min_count=8)
    return pairs.withColumnsRenamed({"item_a": "product_a", "item_b": "product_b"})


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    # products of two counts can be beyond 64 bits
    return p2_pairs(spark, sf).filter("cast(n_ab as decimal(18, 0)) * cast(n_baskets as decimal(18, 0)) >= 5 * (cast(n_a as decimal(18, 0)) * cast(n_b as decimal(18, 0)))").select("product_a", "product_b")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    products = _read(spark, sf, "products")
    valid = latest(products, "product_id", "loaded_at", ["category", "price"])
    name = F.regexp_replace(F.regexp_replace("category", r"(?U)[\s\x1c-\x1f]+", " "), "^ | $", "")
    groups = valid.withColumn("category", F.lower(name)).filter("category != ''")
    return top_n(groups, "category", "price", "product_id", 5, scores=products.select("price")).select("category", "product_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_corpus(_read(spark, sf, "documents"))


def p6_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by source whose ids give back the text."""
    docs = _read(spark, sf, "documents")
    back = decode_corpus(encode_corpus(docs.select(F.struct("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("md5")).alias("row"), "text"), "row"), "row")
    return back.groupBy(F.col("row.source").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.md5("text") == F.col("row.md5")).alias("n_same"))


def leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(spark, sf).select("item_id", "doc_id").distinct()


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that stay after those with a leak are removed."""
    return drop_leaked(_read(spark, sf, "documents"), leaks(spark, sf)).select("doc_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_spans(_read(spark, sf, "documents"))


def p8_amounts(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    return shared_amounts(docs, shared_spans(docs)).withColumn("share", F.round("share", 6))


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs, "p4_found": p4_found, "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_found": p7_found, "p7_clean": p7_clean, "p8_found": p8_found, "p8_amounts": p8_amounts}
SQL = {"p2_found": P2_FOUND, "p2_pairs": P2_PAIRS, "p4_found": P4_FOUND, "p6_roundtrip": P6_ROUNDTRIP, "p8_found": P8_FOUND, "p8_amounts": P8_AMOUNTS}
