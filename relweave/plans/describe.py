"""A catalog in words and as a JSON Schema, for planners."""

from __future__ import annotations

import json
from typing import Any

from relweave.plans.agent import ProviderInfo
from relweave.plans.compiler import AGGREGATES
from relweave.plans.selectors import OPERATORS
from relweave.sources.catalog import Catalog


def selector_schema(catalog: Catalog) -> dict[str, Any]:
    """The JSON Schema of the three kinds of request, with the catalog's own names."""
    entities = [e.name for e in catalog.schema.entities]
    relations = [r.name for r in catalog.schema.relations]
    text, number, flag = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": "boolean"}
    strings = {"type": "array", "items": text}

    def record(required: list[str], **properties: Any) -> dict[str, Any]:
        return {"type": "object", "required": required, "properties": properties}

    def many(item: dict[str, Any]) -> dict[str, Any]:
        return {"type": "array", "items": item}

    compare = record(["field", "op"], type={"const": "comparison"}, entity=text, field=text, op={"enum": list(OPERATORS)}, value={})
    logic = record(["type", "clauses"], type={"const": "logical"}, op={"enum": ["and", "or"]}, clauses=many({"$ref": "#/$defs/filter"}))
    entity = {"type": "string", "enum": entities}
    clause = record(["entity", "query"], entity=entity, fields=strings, query=text, top_k=number, mode={"enum": ["filter", "boost"]}, threshold={"type": "number"})
    query = record(
        ["op", "root_entity"],
        op={"const": "query"},
        root_entity=entity,
        select=many(record(["expr"], expr=text, alias=text)),
        filters={"$ref": "#/$defs/filter"},
        relations=many({"type": "string", "enum": relations}),
        semantic_clauses=many(clause),
        group_by=many(record(["field"], entity=text, field=text, alias=text)),
        aggregations=many(record(["field", "agg"], field=text, agg={"enum": sorted(AGGREGATES)}, alias=text)),
        limit={"type": ["integer", "null"], "minimum": 0, "default": 1000},
        offset={**number, "default": 0},
        case_sensitivity={**flag, "default": False},
    )
    semantic = record(["op", "entity", "query"], op={"const": "semantic_only"}, entity=entity, fields=strings, query=text, top_k={**number, "default": 100})
    return {"$defs": {"filter": {"oneOf": [compare, logic]}}, "oneOf": [record(["op"], op={"const": "schema"}), semantic, query]}


def describe(name: str, catalog: Catalog) -> ProviderInfo:
    """The catalog as declarations: ``table(column type, ...)`` with the key marked by ``!`` and searchable text by ``~``, then ``from.column > to.column``."""
    s = catalog.schema
    about = [s.description or f"Tables of {s.name}"]
    for e in s.entities:
        columns = ", ".join(c.name + "!" * (c.role == "primary_key") + "~" * c.semantic + f" {c.type}" for c in e.columns)
        about.append(" # ".join([f"{e.name}({columns})", *filter(None, (e.label, e.planning_hint))]))
    for r in s.relations:
        about.append(" # ".join([f"{r.name}: {r.from_entity}.{r.from_column} > {r.to_entity}.{r.to_column}, {r.cardinality}, {r.join}", *filter(None, (r.semantic_hint, r.planning_hint))]))
    about += [f"# {h}" for h in s.planning_hints]
    return ProviderInfo(name, "\n".join(about), ("schema", "row_query", "aggregate", "semantic_search", "cross_source_join"), selector_schema(catalog), tuple(s.examples) or tuple(map(_json, _examples(catalog))))


def _json(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False)


def _examples(catalog: Catalog) -> list[dict[str, Any]]:
    out: list[dict[str, Any]] = [{"op": "schema"}]
    s = catalog.schema
    if s.entities and s.entities[0].columns:
        first, column = s.entities[0], s.entities[0].columns[0].name
        out.append({"op": "query", "root_entity": first.name, "select": [{"expr": f"{first.name}.{column}"}], "limit": 10})
        out.append({"op": "query", "root_entity": first.name, "filters": {"type": "comparison", "field": column, "op": "=", "value": "..."}, "limit": 20})
    for e in s.entities:
        if any(c.semantic for c in e.columns):
            out.append({"op": "semantic_only", "entity": e.name, "query": "...", "top_k": 30})
            break
    if s.relations:
        out.append({"op": "query", "root_entity": s.relations[0].from_entity, "relations": [s.relations[0].name], "limit": 20})
    return out
