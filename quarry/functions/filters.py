"""The filter language of the payloads: nested and/or over comparisons of columns and literals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from quarry.errors import QueryError
from quarry.functions.expr import Col, Expr, InList, Lit, Op, columns

# fixed values: the operators of the payloads, by sign and by word
OPERATORS = {
    "=": "=", "eq": "=", "!=": "!=", "ne": "!=", ">": ">", "gt": ">", ">=": ">=", "gte": ">=",
    "<": "<", "lt": "<", "<=": "<=", "lte": "<=", "in": "in", "not_in": "not_in",
}


def _literal(value) -> Lit:
    if not isinstance(value, bool | int | float | str):
        raise QueryError(f"a literal must be a boolean, number or string: {value!r}")
    return Lit(value)


def _operand(x, many: bool = False) -> Expr | tuple[Expr, ...]:
    match x:
        case {"col": str(name), **rest} if not rest:
            return Col(name)
        case {"lit": list(values), **rest} if not rest and many:
            return tuple(map(_literal, values))
        case {"lit": value, **rest} if not rest:
            return _literal(value)
    raise QueryError(f"an operand must be {{'col': name}} or {{'lit': value}}: {x!r}")


def filter_tree(payload: dict | None) -> Expr | None:
    """The predicate of a payload; None for null, {} and an empty and/or."""
    match payload:
        case None | {} if not payload:
            return None
        case {"and": list(parts), **rest} if not rest:
            return combine("and", map(filter_tree, parts))
        case {"or": list(parts), **rest} if not rest:
            return combine("or", map(filter_tree, parts))
        case {"left": left, "op": op, "right": right, **rest} if not rest:
            if (sign := OPERATORS.get(op)) is None:
                raise QueryError(f"unknown filter operator: {op!r}")
            a, b = _operand(left), _operand(right, sign in ("in", "not_in"))
            if sign in ("in", "not_in"):
                return InList(a, b if isinstance(b, tuple) else (b,), sign == "not_in")
            return Op(sign, a, b)
    raise QueryError(f"malformed filter: {payload!r}")


def combine(sign: str, parts) -> Expr | None:
    kept = [p for p in parts if p is not None]
    return reduce(lambda a, b: Op(sign, a, b), kept) if kept else None


def prune(e: Expr | None, admits: Callable[[str], bool]) -> Expr | None:
    """The predicate without the comparisons that use a column that isn't admitted; of and/or the other side stays."""
    if isinstance(e, Op) and e.sign in ("and", "or"):
        return combine(e.sign, (prune(e.left, admits), prune(e.right, admits)))
    return e if e is not None and all(map(admits, columns(e))) else None


def filter_columns(payload: dict | None) -> list[str]:
    tree = filter_tree(payload)
    return columns(tree) if tree is not None else []
