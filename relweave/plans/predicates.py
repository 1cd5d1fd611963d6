"""Filter trees as column expressions, in three-valued logic.

Strict mode compares as stored. Soft mode (the default of requests) compares text in normal form when the operand is text:
lower case, no outer white space, single inner blanks. A tolerance may widen the soft ``=``:
``contains`` (the value holds the operand) or ``ratcliff`` (similarity of at least 0.85). ``!=`` is always the negation of ``=``.
A soft ``like`` takes the first text of a list (none: every text); other operators refuse a list, but for ``in`` and ``not_in``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.functions.text import norm, norm_value
from relweave.plans.scope import Scope, Slot
from relweave.plans.selectors import Compare, Logic

TOLERANCES = ("none", "contains", "ratcliff")
#: Gives whether a normalised column's value is near to one of the needles; told the table's place and column that it comes from.
Near = Callable[[Column, list[str], Slot, str], Column]


def literal(value: object, kind: T.DataType) -> Column:
    """An operand in the column's type; what can't be read as such is null, and so matches nothing."""
    if isinstance(kind, T.StringType):
        return F.lit(value if value is None or isinstance(value, str) else _text(value))
    if isinstance(kind, T.NumericType) and isinstance(value, float) and not isinstance(value, bool):
        return F.lit(value)  # 1.5 isn't cut to a column of integers
    if isinstance(kind, T.NumericType) and isinstance(value, str) and not isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.lit(value).try_cast(kind).cast("double"), F.lit(value).try_cast("double"))
    return F.lit(value).try_cast(kind)


def _text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _items(value: object) -> list | tuple:
    if not isinstance(value, (list, tuple)):
        raise TypeError("'in' and 'not_in' take a list or tuple")
    return value


def strict(c: Column, kind: T.DataType, op: str, value: object) -> Column:
    if op in ("in", "not_in"):
        given = [literal(v, kind) for v in _items(value)]
        hit = c.isin(*given) if given else F.lit(False)
        return hit if op == "in" else (~hit if given else F.lit(True))
    if isinstance(value, (list, tuple)):
        raise TypeError(f"'{op}' takes a single value")
    if op == "like":
        return F.contains(c.cast("string"), F.lit(_text(value)))
    if op == "ilike":
        return F.contains(F.lower(c.cast("string")), F.lit(_text(value).lower()))
    v = literal(value, kind)
    return {"=": c == v, "!=": c != v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[op]


def soft(c: Column, op: str, value: object, tolerance: str, near: Callable[[Column, list[str]], Column] | None) -> Column:
    n = norm(c.cast("string"))
    if op in ("like", "ilike"):
        first = (value[0] if value else "") if isinstance(value, (list, tuple)) else value
        return F.contains(n, F.lit(norm_value(first)))
    given = [norm_value(v) for v in (value if isinstance(value, (list, tuple)) else [value])]
    hit = n.isin(given) if given else F.lit(False)
    if given and tolerance == "contains" and op in ("=", "!="):
        hit = hit | F.contains(n, F.lit(given[0]))
    if given and tolerance == "ratcliff":
        if near is None:
            raise ValueError("this place doesn't support the ratcliff tolerance")
        hit = hit | near(n, [g for g in given])
    if op in ("=", "in"):
        return hit
    return ~hit if given else F.lit(True)


def comparison(f: Compare, scope: Scope, case_sensitive: bool, tolerance: str, near: Near | None) -> Column:
    c, kind, _ = scope.resolve(f.field, f.entity)
    if f.op in ("in", "not_in"):
        _items(f.value)
    elif isinstance(f.value, (list, tuple)) and (case_sensitive or f.op not in ("like", "ilike")):
        raise TypeError(f"'{f.op}' takes a single value")
    texts = [f.value] if not isinstance(f.value, (list, tuple)) else list(f.value)
    is_text = (bool(texts) or f.op in ("like", "ilike")) and all(isinstance(v, str) for v in texts) and isinstance(kind, T.StringType)
    if not case_sensitive and is_text and f.op in ("=", "!=", "in", "not_in", "like", "ilike"):
        owner, column = scope.split(f.field, f.entity)
        own = (lambda n, needles: near(n, needles, scope.slot(owner), column)) if near else None
        return soft(c, f.op, f.value, tolerance, own)
    return strict(c, kind, f.op, f.value)


def tree(f: Compare | Logic | None, scope: Scope, case_sensitive: bool, tolerance: str = "none", near: Near | None = None) -> Column | None:
    """The tree's expression; null where it says nothing (an empty list of clauses)."""
    if f is None:
        return None
    if isinstance(f, Compare):
        return comparison(f, scope, case_sensitive, tolerance, near)
    parts = [p for c in f.clauses if (p := tree(c, scope, case_sensitive, tolerance, near)) is not None]
    return reduce((lambda a, b: a & b) if f.op == "and" else (lambda a, b: a | b), parts) if parts else None
