"""Expressions as small immutable trees, compiled to Spark columns late.

A tree shows which columns and aggregates it uses. Join synthesis, filter pruning and the choice of a pre-aggregation
need that, and Spark's own columns don't say it through a public interface.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quarry.errors import QueryError

Resolver = Callable[[str], Column]


class Expr:
    """A node. Operators build larger trees, as with Spark's columns."""

    def __add__(self, o):
        return Op("+", self, lit(o))

    def __sub__(self, o):
        return Op("-", self, lit(o))

    def __mul__(self, o):
        return Op("*", self, lit(o))

    def __truediv__(self, o):
        return Op("/", self, lit(o))

    def __rmul__(self, o):
        return Op("*", lit(o), self)

    def __radd__(self, o):
        return Op("+", lit(o), self)

    def __rsub__(self, o):
        return Op("-", lit(o), self)

    def __gt__(self, o):
        return Op(">", self, lit(o))

    def __ge__(self, o):
        return Op(">=", self, lit(o))

    def __lt__(self, o):
        return Op("<", self, lit(o))

    def __le__(self, o):
        return Op("<=", self, lit(o))

    def __and__(self, o):
        return Op("and", self, lit(o))

    def __or__(self, o):
        return Op("or", self, lit(o))

    def __invert__(self):
        return Not(self)

    # == and != stay Python's, so that trees can be compared and kept in sets
    def eq(self, o):
        return Op("=", self, lit(o))

    def ne(self, o):
        return Op("!=", self, lit(o))

    def alias(self, name: str):
        return Alias(self, name)

    def cast(self, to: str):
        return Cast(self, to)

    def isin(self, *items):
        return InList(self, tuple(map(lit, items)))

    def between(self, low, high):
        return (self >= low) & (self <= high)

    def like(self, pattern: str):
        return Func("like", (self, Lit(pattern)))

    def is_null(self):
        return Func("isnull", (self,))

    def is_not_null(self):
        return Func("isnotnull", (self,))

    def over(self, partition_by=(), order_by=(), rows: tuple | None = None, range_: tuple | None = None):
        return Over(self, tuple(map(col, partition_by)), tuple(map(col, order_by)), rows, range_)

    def asc(self, nulls_first: bool = False):
        return Sort(self, False, nulls_first)

    def desc(self, nulls_first: bool = False):
        return Sort(self, True, nulls_first)


@dataclass(frozen=True)
class Col(Expr):
    name: str  # "table.column", or a name that with_columns gave


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Alias(Expr):
    of: Expr
    name: str


@dataclass(frozen=True)
class Cast(Expr):
    of: Expr
    to: str


@dataclass(frozen=True)
class Op(Expr):
    sign: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    of: Expr


@dataclass(frozen=True)
class InList(Expr):
    of: Expr
    items: tuple[Expr, ...]
    negated: bool = False


@dataclass(frozen=True)
class Func(Expr):
    """A function of pyspark.sql.functions, or a method of Column, by name."""

    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Case(Expr):
    when: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None = None


@dataclass(frozen=True)
class Agg(Expr):
    fn: str
    of: Expr | None  # None: count(*)
    distinct: bool = False
    where: Expr | None = None


@dataclass(frozen=True)
class Sort(Expr):
    of: Expr
    descending: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class Over(Expr):
    of: Expr
    partition_by: tuple[Expr, ...] = ()
    order_by: tuple[Expr, ...] = ()
    rows: tuple | None = None
    range_: tuple | None = None


@dataclass(frozen=True)
class Raw(Expr):
    """A Spark column as it is. It names the columns that it reads; pre-aggregations never serve it."""

    column: Column = field(compare=False)
    refs: tuple[str, ...]
    key: str = ""


def col(x: str | Expr) -> Expr:
    return x if isinstance(x, Expr) else Col(x)


def lit(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


def func(name: str, *args) -> Func:
    return Func(name, tuple(map(col, args)))


def nullif(a, b) -> Func:
    return Func("nullif", (col(a), lit(b)))


def case(*when: tuple[Expr, Any], otherwise: Any = None) -> Case:
    return Case(tuple((c, lit(v)) for c, v in when), None if otherwise is None else lit(otherwise))


def _agg(fn: str):
    return lambda x, where=None: Agg(fn, col(x), False, where)


sum_, min_, max_, avg, median = map(_agg, ("sum", "min", "max", "avg", "median"))
stddev, stddev_pop, var_samp, var_pop = map(_agg, ("stddev", "stddev_pop", "variance", "var_pop"))


def count(x: str | Expr | None = None, where=None) -> Agg:
    return Agg("count", None if x is None else col(x), False, where)


def count_distinct(x: str | Expr) -> Agg:
    return Agg("count", col(x), True)


def _parts(value) -> Iterator[Expr]:
    if isinstance(value, Expr):
        yield value
    elif isinstance(value, tuple):
        for v in value:
            yield from _parts(v)


def children(e: Expr) -> list[Expr]:
    return [c for f in fields(e) for c in _parts(getattr(e, f.name))]


def walk(e: Expr) -> Iterator[Expr]:
    yield e
    for c in children(e):
        yield from walk(c)


def rewrite(e: Expr, change: Callable[[Expr], Expr | None]) -> Expr:
    """`e` with each node, from the top, replaced by what `change` makes of it; None: its parts are looked at."""
    if (new := change(e)) is not None:
        return new

    def again(v):
        return rewrite(v, change) if isinstance(v, Expr) else tuple(map(again, v)) if isinstance(v, tuple) else v

    return replace(e, **{f.name: again(getattr(e, f.name)) for f in fields(e)})


def columns(e: Expr) -> list[str]:
    """Names of all columns in the tree, in order, once each."""
    return list(dict.fromkeys(n for x in walk(e) for n in ([x.name] if isinstance(x, Col) else x.refs if isinstance(x, Raw) else ())))


def aggregates(e: Expr) -> list[Agg]:
    return [x for x in walk(e) if isinstance(x, Agg)]


def bare(e: Expr | None) -> str | None:
    """The column's name, if the expression is just a column."""
    return e.name if isinstance(e, Col) else None


def outside_aggregates(e: Expr) -> list[str]:
    if isinstance(e, Agg):
        return []
    own = [e.name] if isinstance(e, Col) else list(e.refs) if isinstance(e, Raw) else []
    return list(dict.fromkeys(own + [n for c in children(e) for n in outside_aggregates(c)]))


def output_name(e: Expr) -> str:
    match e:
        case Alias(_, name) | Col(name):
            return name
        case Agg(fn, of, distinct, _):
            return f"{fn}({'distinct ' * distinct}{output_name(of) if of else '*'})"
        case Cast(of, _):
            return output_name(of)
        case Lit(value):
            return repr(value)
        case Op(sign, left, right):
            return f"({output_name(left)} {sign} {output_name(right)})"
        case Func(name, args):
            return f"{name}({', '.join(map(output_name, args))})"
    return type(e).__name__.lower()


def qualified(name: str) -> Column:
    """A column by table and name before aggregation; a name without a table is what with_columns gave."""
    table, dot, column = name.partition(".")
    return F.col(f"`{table}`.`{column}`") if dot else F.col(f"`{name}`")


def flat(name: str) -> Column:
    """A column of a result, whose name has the dot in it."""
    return F.col(f"`{name}`")


_SIGNS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b),
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b,
}

_AGGREGATES = {
    "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg, "mean": F.avg, "median": F.median,
    "stddev": F.stddev_samp, "stddev_samp": F.stddev_samp, "std": F.stddev_samp, "stddev_pop": F.stddev_pop,
    "variance": F.var_samp, "var": F.var_samp, "var_samp": F.var_samp, "var_pop": F.var_pop,
    "first": F.first, "last": F.last, "approx_count_distinct": F.approx_count_distinct,
}


def compile_expr(e: Expr, resolve: Resolver, aggregate: Callable[[Agg], Column] | None = None) -> Column:
    """The tree as a Spark column. `aggregate` may compile aggregates in its own way."""

    def go(x: Expr) -> Column:
        match x:
            case Col(name):
                return resolve(name)
            case Lit(value):
                return F.lit(value)
            case Alias(of, name):
                return go(of).alias(name)
            case Cast(of, to):
                return go(of).cast(to)
            case Op(sign, left, right):
                return _SIGNS[sign](go(left), go(right))
            case Not(of):
                return ~go(of)
            case InList(of, items, negated):
                found = go(of).isin(*map(go, items))
                return ~found if negated else found
            case Func(name, args):
                first, *rest = map(go, args)
                if not hasattr(F, name) or name == "like":
                    return getattr(first, name)(*(a.value for a in args[1:]))
                try:
                    return getattr(F, name)(first, *rest)
                except TypeError:  # where Python's form wants a plain value, SQL's takes a literal
                    return F.call_function(name, first, *rest)
            case Case(when, otherwise):
                out = reduce(lambda c, w: c.when(go(w[0]), go(w[1])), when, F)
                return out if otherwise is None else out.otherwise(go(otherwise))
            case Agg():
                return aggregate(x) if aggregate else plain(x)
            case Sort(of, descending, nulls_first):
                return getattr(go(of), f"{'desc' if descending else 'asc'}_nulls_{'first' if nulls_first else 'last'}")()
            case Over(of, partition_by, order_by, rows, range_):
                w = Window.partitionBy(*map(go, partition_by)) if partition_by else Window.partitionBy()
                w = w.orderBy(*(go(o if isinstance(o, Sort) else Sort(o)) for o in order_by)) if order_by else w
                w = w.rowsBetween(*rows) if rows else w.rangeBetween(*range_) if range_ else w
                return (getattr(F, of.name)(*(a.value if isinstance(a, Lit) else go(a) for a in of.args)) if isinstance(of, Func) else go(of)).over(w)
            case Raw(column, _, _):
                return column
        raise TypeError(f"not an expression: {x!r}")

    def plain(x: Agg) -> Column:
        value = F.lit(1) if x.of is None else go(x.of)
        if x.where is not None:
            value = F.when(go(x.where), value)
        if x.distinct:
            if x.fn in ("min", "max"):
                return _AGGREGATES[x.fn](value)
            if x.fn in ("avg", "mean"):
                return F.try_divide(F.sum_distinct(value), F.count_distinct(value))
            if x.fn not in ("count", "sum"):
                raise QueryError(f"{x.fn} can't be taken of distinct values")
            return F.count_distinct(value) if x.fn == "count" else F.sum_distinct(value)
        return _AGGREGATES[x.fn](value)

    return go(e)
