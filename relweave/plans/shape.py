"""Results as nested rows or text; only these few functions take rows to the driver."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.plans.compiler import Compiled
from relweave.plans.scope import quoted

SHOWN = 10


def nested(result: Compiled) -> DataFrame:
    """``entity, data struct, related struct`` of a row result."""

    def pack(names: dict[str, str]):
        return F.struct(*[F.col(quoted(c)).alias(n) for n, c in names.items()])

    related = F.struct(*[pack(cols).alias(k) for k, cols in result.related.items()]) if result.related else F.lit(None).cast("struct<none: string>")
    return result.frame.select(F.lit(result.entity).alias("entity"), pack(result.data).alias("data"), related.alias("related"))


def rows(result: Compiled, most: int | None = None) -> list[dict[str, Any]]:
    """Rows as dicts of root fields with related fields below their label."""
    frame = result.frame if most is None else result.frame.limit(most)
    out = []
    for r in frame.collect():
        values = dict(zip(frame.columns, r))
        out.append({"entity": result.entity, "data": {n: values[c] for n, c in result.data.items()}, "related": {k: {n: values[c] for n, c in cols.items()} for k, cols in result.related.items()}})
    return out


def serialize(result: Compiled, catalog_text: str = "", count_rest: bool = True) -> str:
    """The first rows as text, with a note of how many more there are, or, without ``count_rest``, that there are more."""
    if result.kind == "schema":
        return catalog_text
    if result.kind == "matches":
        return "Semantic matches: " + "; ".join(f"{result.entity}:{r['id']} ({r['score']:.2f})" for r in result.frame.limit(SHOWN).collect())
    if result.kind == "aggregations":
        row = result.frame.first()
        return "Aggregations: " + ", ".join(f"{n}={row[c]}" for n, c in result.data.items())
    lines = []
    first = rows(result, SHOWN + 1)
    for r in first[:SHOWN]:
        parts = [f"{k}={v}" for k, v in r["data"].items()] + [f"{k}=" + ",".join(f"{n}:{v}" for n, v in d.items()) for k, d in r["related"].items()]
        lines.append(" | ".join(parts))
    if len(first) > SHOWN:
        lines.append(f"... trimmed {result.frame.count() - SHOWN} rows ..." if count_rest else "... more rows ...")
    return "\n".join(lines) or "(empty result)"


def schema_text(entities: list[str], relations: list[str]) -> str:
    return f"Schema: entities=({', '.join(entities)}); relations=({', '.join(relations)})"
