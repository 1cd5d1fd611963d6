"""JSON selectors as typed requests."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "in", "not_in", "like", "ilike")


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: Any
    entity: str | None = None


@dataclass(frozen=True)
class Logic:
    op: str = "and"
    clauses: tuple[Compare | Logic, ...] = ()


@dataclass(frozen=True)
class Select:
    expr: str
    alias: str | None = None


@dataclass(frozen=True)
class Semantic:
    entity: str
    query: str
    fields: tuple[str, ...] = ()
    top_k: int = 100
    mode: str = "filter"
    threshold: float | None = None


@dataclass(frozen=True)
class Aggregate:
    field: str
    agg: str
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or f"{self.agg}_{self.field}"


@dataclass(frozen=True)
class Group:
    field: str
    entity: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Query:
    root_entity: str
    select: tuple[Select, ...] = ()
    filters: Compare | Logic | None = None
    relations: tuple[str, ...] = ()
    semantic_clauses: tuple[Semantic, ...] = ()
    group_by: tuple[Group, ...] = ()
    aggregations: tuple[Aggregate, ...] = ()
    limit: int | None = 1000
    offset: int = 0
    case_sensitivity: bool = False


@dataclass(frozen=True)
class SemanticOnly:
    entity: str
    query: str
    fields: tuple[str, ...] = ()
    top_k: int = 100


@dataclass(frozen=True)
class SchemaOnly:
    op: str = field(default="schema")


def _need(raw: Mapping[str, Any], what: str, *names: str) -> None:
    for n in names:
        if raw.get(n) is None:
            raise ValueError(f"{what} needs {n!r}")


def _strings(value: Any) -> tuple[str, ...]:
    if value is None:
        return ()
    return (value,) if isinstance(value, str) else tuple(map(str, value))


def parse_filter(raw: Mapping[str, Any] | None) -> Compare | Logic | None:
    if raw is None:
        return None
    if raw.get("type") == "logical" or "clauses" in raw:
        op = raw.get("op", "and")
        if op not in ("and", "or"):
            raise ValueError(f"Unsupported logical op: {op}")
        return Logic(op, tuple(parse_filter(c) for c in raw.get("clauses") or ()))
    _need(raw, "a comparison", "field", "op")
    if raw["op"] not in OPERATORS:
        raise ValueError(f"Unsupported comparison op: {raw['op']}")
    return Compare(raw["field"], raw["op"], raw.get("value"), raw.get("entity"))


def parse(raw: Mapping[str, Any]) -> Query | SemanticOnly | SchemaOnly:
    """A request from its JSON object; keys that aren't known are passed over."""
    op = raw.get("op")
    if op is None:
        raise ValueError("Selectors must include 'op'")
    if op == "schema":
        return SchemaOnly()
    if op == "semantic_only":
        _need(raw, "semantic_only", "entity", "query")
        return SemanticOnly(raw["entity"], raw["query"], _strings(raw.get("fields")), int(raw.get("top_k", 100)))
    if op != "query":
        raise ValueError(f"Unsupported op: {op}")
    _need(raw, "query", "root_entity")
    clauses = []
    for c in raw.get("semantic_clauses") or ():
        _need(c, "a semantic clause", "entity", "query")
        if (mode := c.get("mode", "filter")) not in ("filter", "boost"):
            raise ValueError(f"Unsupported semantic mode: {mode}")
        clauses.append(Semantic(c["entity"], c["query"], _strings(c.get("fields")), int(c.get("top_k", 100)), mode, c.get("threshold")))
    for part, names in (("select", ["expr"]), ("aggregations", ["field", "agg"]), ("group_by", ["field"])):
        for x in raw.get(part) or ():
            _need(x, part, *names)
    return Query(
        root_entity=raw["root_entity"],
        select=tuple(Select(s["expr"], s.get("alias")) for s in raw.get("select") or ()),
        filters=parse_filter(raw.get("filters")),
        relations=tuple(raw.get("relations") or ()),
        semantic_clauses=tuple(clauses),
        group_by=tuple(Group(g["field"], g.get("entity"), g.get("alias")) for g in raw.get("group_by") or ()),
        aggregations=tuple(Aggregate(a["field"], a["agg"], a.get("alias")) for a in raw.get("aggregations") or ()),
        limit=raw.get("limit", 1000),
        offset=raw.get("offset") or 0,
        case_sensitivity=bool(raw.get("case_sensitivity", False)),
    )
