"""Declared cardinalities held against the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.plans.scope import quoted
from relweave.sources.catalog import Catalog, Relation


def to_one(relation: Relation, forward: bool) -> bool:
    """Whether a step along the relation may meet at most one row; walked backwards, the sides change places."""
    return relation.cardinality == "1_to_1" or relation.cardinality == ("many_to_1" if forward else "1_to_many")


def check_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, relation: Relation, forward: bool) -> None:
    """Raise if a key of the left rows meets several right rows although the relation is to-one. Runs a small job; off by default."""
    if not to_one(relation, forward):
        return
    keys = left.select(F.col(quoted(left_key)).alias("__k")).filter("__k is not null").distinct()
    counts = right.select(F.col(quoted(right_key)).alias("__k")).groupBy("__k").count().filter("count > 1")
    if bad := counts.join(keys, "__k", "left_semi").limit(1).collect():
        raise ValueError(f"Cardinality {relation.cardinality} violated for relation '{relation.name}': key {bad[0]['__k']!r} has {bad[0]['count']} matches")


def violating_keys(catalog: Catalog, name: str) -> DataFrame:
    """``key, n_rows``: referenced keys of a relation's far side that stand in several rows."""
    r = catalog.relation(name)
    keys = catalog.table(r.from_entity).select(F.col(r.from_column).alias("key")).filter("key is not null").distinct()
    far = catalog.table(r.to_entity).select(F.col(r.to_column).alias("key"))
    return far.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1").join(keys, "key", "left_semi")
