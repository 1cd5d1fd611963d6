"""A selector as one lazy DataFrame.

Order: scan, joins in the order named, filters, semantic clauses, then aggregation or projection, sort, offset, limit.
Catalyst pushes the filters below the joins and prunes columns where that is legal. Nothing runs before an action, but for
an offset without a limit (or a very large one), which first looks for the key at that position.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.functions.ratcliff import near_values
from relweave.functions.text import norm
from relweave.plans import predicates
from relweave.plans.cardinality import check_join
from relweave.plans.paging import page
from relweave.plans.scope import Scope, Slot, enter, quoted
from relweave.plans.selectors import Query, SchemaOnly, SemanticOnly, parse
from relweave.semantic.clauses import apply_clauses
from relweave.sources.catalog import JOINS, Catalog

SCORE = "semantic:score"
#: Aggregates by name. ``count`` counts values that aren't null, ``size`` rows.
AGGREGATES = {
    "count": F.count,
    "count_distinct": F.count_distinct,
    "nunique": F.count_distinct,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
    "mean": F.avg,
    "median": F.median,
    "std": F.stddev_samp,
    "stddev": F.stddev_samp,
    "stddev_samp": F.stddev_samp,
    "stddev_pop": F.stddev_pop,
    "var": F.var_samp,
    "variance": F.var_samp,
    "var_samp": F.var_samp,
    "var_pop": F.var_pop,
    "first": lambda c: F.first(c, ignorenulls=True),
    "last": lambda c: F.last(c, ignorenulls=True),
    "size": lambda c: F.count(F.lit(1)),
    "product": F.product,
    "bool_and": F.bool_and,
    "bool_or": F.bool_or,
    "any": lambda c: F.bool_or(c.cast("boolean")),
    "all": lambda c: F.bool_and(c.cast("boolean")),
    "any_value": lambda c: F.any_value(c, F.lit(True)),
    "mode": lambda c: F.mode(c, True),
    "quantile": F.median,
    "prod": F.product,
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "skew": lambda c: _sample_skew(c),
}


def _sample_skew(c: Column) -> Column:
    """Skewness without bias, null for fewer than three values and 0 for equal ones."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.coalesce(F.nanvl(F.skewness(c), F.lit(0.0)), F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def aggregate(spark: SparkSession, name: str) -> Callable[[Column], Column]:
    """An aggregate by its name here, else by that of a function that the session knows (its own or one of the user's)."""
    if name in AGGREGATES:
        return AGGREGATES[name]
    if not re.fullmatch(r"[A-Za-z_]\w*", name) or not spark.catalog.functionExists(name):
        raise ValueError(f"Unsupported aggregation: {name}")
    return lambda c: F.call_function(name, c)


@dataclass(frozen=True)
class Options:
    """What a selector can't say. ``tolerance``: of the soft ``=``; ``null_equal``: null join keys match each other; ``check_cardinality``:
    fail where a relation declared to-one has several matches; ``order_by_key``: sort by the root's key when paging;
    ``offset_on_root``: filter, order and skip rows of the root before the joins, so that the offset counts root rows; ``push_keys``: where an inner or left join meets a
    table over a connection, and there are at most so many distinct keys so far, they are sent along as a filter (this asks for the keys first)."""

    tolerance: str = "none"
    null_equal: bool = False
    check_cardinality: bool = False
    order_by_key: bool = True
    offset_on_root: bool = False
    push_keys: int = 0

    def __post_init__(self) -> None:
        if self.tolerance not in predicates.TOLERANCES:
            raise ValueError(f"Unknown tolerance {self.tolerance!r}")


@dataclass
class Compiled:
    """The frame, which of its columns belong to which related table, and what the request touched."""

    frame: DataFrame
    data: dict[str, str] = field(default_factory=dict)
    related: dict[str, dict[str, str]] = field(default_factory=dict)
    kind: str = "rows"
    entity: str | None = None
    meta: dict[str, Any] = field(default_factory=dict)


def execute(catalog: Catalog, selector: Mapping[str, Any], options: Options | None = None) -> DataFrame:
    """The lazy result of a JSON selector."""
    return compile_request(catalog, selector, options).frame


def compile_request(catalog: Catalog, selector: Mapping[str, Any], options: Options | None = None) -> Compiled:
    request = parse(selector)
    if isinstance(request, SchemaOnly):
        return Compiled(catalog.entities_frame(), kind="schema")
    kind = "semantic_only" if isinstance(request, SemanticOnly) else "query"
    if kind in catalog.handlers:
        frame = catalog.handlers[kind](request)
        return Compiled(frame, {c: c for c in frame.columns}, kind="matches" if kind == "semantic_only" else "rows", entity=request.entity if kind == "semantic_only" else request.root_entity)
    if isinstance(request, SemanticOnly):
        catalog.entity(request.entity)
        if catalog.semantic is None:
            raise RuntimeError("No semantic backend is configured")
        return Compiled(catalog.semantic.search(request.entity, list(request.fields), request.query, request.top_k), kind="matches", entity=request.entity)
    return compile_query(catalog, request, options or Options())


def join_chain(catalog: Catalog, q: Query, options: Options) -> tuple[DataFrame, Scope]:
    df, root = enter(catalog.table(q.root_entity), 0, q.root_entity, None, catalog.columns(q.root_entity))
    scope = Scope(root)
    if options.offset_on_root:
        df = _with_near(catalog, df, q, scope, options)
        key = quoted(root.internal(catalog.primary_key(q.root_entity)))
        df = page(df, [(F.col(key), False)], None, q.offset)
    for name in q.relations:
        r = catalog.relation(name)
        if scope.has(r.from_entity):
            (near, near_col), (far, far_col), forward = (r.from_entity, r.from_column), (r.to_entity, r.to_column), True
        elif scope.has(r.to_entity):
            (near, near_col), (far, far_col), forward = (r.to_entity, r.to_column), (r.from_entity, r.from_column), False
        else:
            raise ValueError(f"Neither entity of relation '{name}' present in query")
        if any(s.key == name for s in scope.joined):
            raise ValueError(f"Duplicate relation key '{name}' in joins")
        left = scope.slot(near)
        if near_col not in left.columns:
            raise KeyError(f"Column '{near_col}' not found in '{near}'")
        table, slot = enter(catalog.table(far), len(scope.joined) + 1, far, name, catalog.columns(far))
        if far_col not in slot.columns:
            raise KeyError(f"Column '{far_col}' not found in '{far}'")
        a, b = F.col(quoted(left.internal(near_col))), F.col(quoted(slot.internal(far_col)))
        if options.check_cardinality:
            check_join(df, table, left.internal(near_col), slot.internal(far_col), r, forward)
        if options.push_keys and far in catalog.remote and r.join in ("inner", "left") and not options.null_equal:
            keys = [x[0] for x in df.select(a).filter(a.isNotNull()).distinct().limit(options.push_keys + 1).collect()]
            if len(keys) <= options.push_keys:
                table = table.filter(b.isin(keys))
        df = df.join(table, a.eqNullSafe(b) if options.null_equal else a == b, JOINS[r.join])
        scope.joined.append(slot)
    return df, scope


def _with_near(catalog: Catalog, df: DataFrame, q: Query, scope: Scope, options: Options) -> DataFrame:
    """Filters; near matches are worked out on the distinct values of a column of its own table and joined to the rows."""
    added: list[str] = []
    frame = df

    def near(n: Column, needles: list[str], slot: Slot, column: str) -> Column:
        nonlocal frame
        value, mark = f"near:{len(added)}", f"near:{len(added)}:hit"
        frame = frame.withColumn(value, n)
        base = catalog.table(slot.entity).select(norm(F.col(quoted(column)).cast("string")).alias("value"))
        hits = near_values(base, "value", needles).select(F.col("value").alias(mark))
        frame = frame.join(hits, F.col(quoted(value)) == F.col(quoted(mark)), "left")
        added.extend((value, mark))
        # null stays null, so that a negation doesn't keep rows without a value
        return F.when(F.col(quoted(value)).isNotNull(), F.col(quoted(mark)).isNotNull())

    where = predicates.tree(q.filters, scope, q.case_sensitivity, options.tolerance, near)
    return df if where is None else frame.filter(where).drop(*added)


def compile_query(catalog: Catalog, q: Query, options: Options) -> Compiled:
    if not isinstance(q.offset, int) or q.offset < 0 or (q.limit is not None and q.limit < 0):
        raise ValueError("limit and offset can't be negative")
    df, scope = join_chain(catalog, q, options)
    if options.offset_on_root:
        q = replace(q, offset=0)
    else:
        df = _with_near(catalog, df, q, scope, options)
    if q.semantic_clauses:
        df = apply_clauses(catalog, df, q.semantic_clauses, lambda entity: _key_column(catalog, scope, entity), SCORE)
    meta: dict[str, Any] = {"relations_used": list(q.relations)}
    if len(sources := {catalog.origin.get(s.entity, "") for s in [scope.root, *scope.joined]} - {""}) > 1:
        meta["sources"] = sorted(sources)
    if q.group_by or q.aggregations:
        meta["group_by"] = [g.field for g in q.group_by]
        return _aggregate(df, q, scope, meta)
    return _project(catalog, df, q, scope, options, meta)


def _key_column(catalog: Catalog, scope: Scope, entity: str) -> Column:
    slot = scope.slot(entity)
    return F.col(quoted(slot.internal(catalog.primary_key(slot.entity))))


def _aggregate(df: DataFrame, q: Query, scope: Scope, meta: dict[str, Any]) -> Compiled:
    groups = []
    for g in q.group_by:
        c, _, name = scope.resolve(g.field, g.entity)
        groups.append(c.alias(g.alias or name))
    names = [g.alias or scope.resolve(g.field, g.entity)[2] for g in q.group_by]
    aggs = []
    for a in q.aggregations:
        aggs.append(aggregate(df.sparkSession, a.agg)(scope.resolve(a.field)[0]).alias(a.name))
    if not groups:  # one row; paging doesn't apply
        return Compiled(df.agg(*aggs), {a.name: a.name for a in q.aggregations}, kind="aggregations", entity=q.root_entity, meta=meta)
    aggs = aggs or [F.count(F.lit(1)).alias("count")]
    order = [(F.col(quoted(n)), False) for n in names]  # one row a group, so nothing ties
    if q.semantic_clauses:
        out = df.groupBy(*groups).agg(*aggs, F.sum(quoted(SCORE)).alias(SCORE))
        out = page(out, [(F.col(quoted(SCORE)), True), *order], q.limit, q.offset).drop(SCORE)
    else:
        out = df.groupBy(*groups).agg(*aggs)
        out = page(out, order if q.limit is not None or q.offset else [], q.limit, q.offset)
    return Compiled(out, {c: c for c in out.columns}, entity=q.root_entity, meta=meta)


def _project(catalog: Catalog, df: DataFrame, q: Query, scope: Scope, options: Options, meta: dict[str, Any]) -> Compiled:
    data: dict[str, str] = {}
    related: dict[str, dict[str, str]] = {}
    columns: list[Column] = []
    if q.select:
        for s in q.select:
            c, _, name = scope.resolve(s.expr)
            owner, column = scope.split(s.expr)
            out = s.alias or name
            columns.append(c.alias(out))
            (data if owner == scope.root.entity else related.setdefault(owner, {}))[s.alias or column] = out
    else:
        slots: list[tuple[Slot, str | None]] = [(scope.root, None), *((s, scope.label(s)) for s in scope.joined)]
        for slot, label in slots:
            for c in slot.columns:
                out = c if label is None else f"{label}__{c}"
                columns.append(F.col(quoted(slot.internal(c))).alias(out))
                (data if label is None else related.setdefault(label, {}))[c] = out
    key = catalog.entity(q.root_entity).primary_key
    order: list[tuple[str, Column, bool]] = []
    if q.semantic_clauses:
        order.append(("order:score", F.col(quoted(SCORE)), True))
    if key in scope.root.columns and (q.semantic_clauses or (options.order_by_key and q.offset)):
        order.append(("order:key", F.col(quoted(scope.root.internal(key))), False))
    out = df.select(*columns, *[c.alias(n) for n, c, _ in order])
    names = out.columns[: len(columns)]
    ambiguous = len(set(names)) < len(names)
    out = page(out, [(F.col(quoted(n)), down) for n, _, down in order], q.limit, q.offset, () if ambiguous else names)
    return Compiled(out.drop(*[n for n, _, _ in order]), data, related, entity=q.root_entity, meta=meta)


def normalised(c: Column) -> Column:
    """The normal form that soft comparisons use."""
    return norm(c)
