"""Semantic clauses of a query as joins with a backend's matches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.plans.scope import quoted
from relweave.plans.selectors import Semantic

#: Matches up to this number are broadcast; more are joined like any other table.
BROADCAST = 100_000


def apply_clauses(catalog: Any, df: DataFrame, clauses: tuple[Semantic, ...], key: Callable[[str], Column], score: str) -> DataFrame:
    """Rows with the sum of all clauses' scores in the column ``score``.

    ``filter`` keeps the matched rows, ``boost`` keeps all; the threshold applies after the top k. An id that
    is matched several times has its best score.
    """
    if catalog.semantic is None:
        raise RuntimeError("No semantic backend is configured")
    total = F.lit(0.0)
    added = []
    for i, c in enumerate(clauses):
        on = key(c.entity)
        entity = c.entity if any(e.name == c.entity for e in catalog.schema.entities) else catalog.relation(c.entity).to_entity
        found = catalog.semantic.search(entity, list(c.fields), c.query, c.top_k)
        if c.threshold is not None:
            found = found.filter(F.col("score") >= c.threshold)
        id_, own = f"semantic:{i}:id", f"semantic:{i}:score"
        found = found.groupBy(F.col("id").alias(id_)).agg(F.max("score").alias(own))
        if c.top_k <= BROADCAST:
            found = F.broadcast(found)
        df = df.join(found, on == F.col(quoted(id_)), "inner" if c.mode == "filter" else "left")
        total = total + F.coalesce(F.col(quoted(own)), F.lit(0.0))
        added += [id_, own]
    return df.withColumn(score, total).drop(*added)
