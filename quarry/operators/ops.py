"""The recordable operations: each knows the columns it reads and how to apply itself to a frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import QueryError
from quarry.functions.expr import Alias, Cast, Col, Expr, Resolver, Sort, bare, columns, compile_expr, output_name

# numeric types by width: a cast to a later one of the same row loses nothing
WIDENING = ({"tinyint": 0, "smallint": 1, "int": 2, "integer": 2, "bigint": 3, "long": 3}, {"float": 0, "real": 0, "double": 1})


@dataclass(frozen=True)
class Operation:
    def reads(self) -> list[str]:
        """Columns that the operation reads as they are, outside aggregates."""
        return []

    def keeps_pre_agg(self, type_of: Callable[[str], str | None]) -> bool:
        """Whether aggregates above it may be read from a rollup of the rows below it."""
        return False

    def apply(self, df: DataFrame, resolve: Resolver) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class Filter(Operation):
    predicate: Expr

    def reads(self):
        return columns(self.predicate)

    def keeps_pre_agg(self, type_of):
        return True

    def apply(self, df, resolve):
        return df.filter(compile_expr(self.predicate, resolve))


@dataclass(frozen=True)
class WithColumns(Operation):
    exprs: tuple[Expr, ...]

    def renames(self) -> dict[str, str]:
        """New name to source column, for plain renames and casts of columns."""
        found = ((output_name(e), bare(e.of.of if isinstance(e, Alias) and isinstance(e.of, Cast) else e.of if isinstance(e, Alias | Cast) else e)) for e in self.exprs)
        return {name: source for name, source in found if source}

    def reads(self):
        return [c for e in self.exprs if output_name(e) not in self.renames() for c in columns(e)]

    def joined(self) -> list[str]:
        return [c for e in self.exprs for c in columns(e)]

    def keeps_pre_agg(self, type_of):
        def lossless(e: Expr) -> bool:
            e = e.of if isinstance(e, Alias) else e
            if isinstance(e, Cast) and (source := bare(e.of)):
                have = type_of(source)
                return have == e.to or any(have in w and e.to in w and w[have] <= w[e.to] for w in WIDENING)
            return isinstance(e, Col)

        return all(map(lossless, self.exprs))

    def apply(self, df, resolve):
        return df.withColumns({output_name(e): compile_expr(e.of if isinstance(e, Alias) else e, resolve) for e in self.exprs})


@dataclass(frozen=True)
class SortRows(Operation):
    """Ascending unless an expression says otherwise, nulls last."""

    by: tuple[Expr, ...]

    def reads(self):
        return [c for e in self.by for c in columns(e)]

    def keeps_pre_agg(self, type_of):
        return True

    def apply(self, df, resolve):
        return df.orderBy(*(compile_expr(e if isinstance(e, Sort) else Sort(e), resolve) for e in self.by))


@dataclass(frozen=True)
class Limit(Operation):
    skip: int = 0
    fetch: int | None = None

    def apply(self, df, resolve):
        df = df.offset(self.skip) if self.skip else df
        return df if self.fetch is None else df.limit(self.fetch)


@dataclass(frozen=True)
class Distinct(Operation):
    def apply(self, df, resolve):
        return df.distinct()


@dataclass(frozen=True)
class DistinctOn(Operation):
    """The first row of each `on` in the order of `sort`, as `select`; the sort begins with `on`."""

    on: tuple[Expr, ...]
    select: tuple[Expr, ...]
    sort: tuple[Expr, ...] = ()

    def __post_init__(self):
        heads = [e.of if isinstance(e, Sort) else e for e in self.sort[: len(self.on)]]
        if self.sort and set(heads) != set(self.on):
            raise QueryError("the sort of distinct_on must begin with its on expressions")

    def reads(self):
        return [c for e in (*self.on, *self.select, *self.sort) for c in columns(e)]

    def apply(self, df, resolve):
        make = lambda e: compile_expr(e, resolve)
        order = [make(e if isinstance(e, Sort) else Sort(e)) for e in self.sort] or [make(e) for e in self.on]
        first = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*map(make, self.on)).orderBy(*order))).filter("__rank = 1")
        return first.select(*map(make, self.select))


@dataclass(frozen=True)
class Drop(Operation):
    names: tuple[str, ...]

    def keeps_pre_agg(self, type_of):
        return True

    def apply(self, df, resolve):
        return df.drop(*map(resolve, self.names))


@dataclass(frozen=True)
class Union(Operation):
    other: DataFrame = field(compare=False)
    distinct: bool = False
    key: int = 0

    def apply(self, df, resolve):
        both = df.union(self.other)
        return both.distinct() if self.distinct else both


@dataclass(frozen=True)
class WindowColumns(Operation):
    exprs: tuple[Expr, ...]

    def reads(self):
        return [c for e in self.exprs for c in columns(e)]

    def apply(self, df, resolve):
        return df.select("*", *(compile_expr(e, resolve) for e in self.exprs))


# names of join kinds: those that Spark has, and those that are one of these with the sides swapped
SWAPPED = {"right_semi": "left_semi", "right_anti": "left_anti"}


@dataclass(frozen=True)
class JoinFrame(Operation):
    """Any join with a frame on pairs of keys and a further condition. `left_mark` adds the boolean column `mark`: the row has a match."""

    right: DataFrame = field(compare=False)
    how: str = "inner"
    left_on: tuple[str, ...] = ()
    right_on: tuple[str, ...] = ()
    where: Expr | None = None
    key: int = 0

    def reads(self):
        return [*self.left_on, *(columns(self.where) if self.where is not None else ())]

    def apply(self, df, resolve):
        right = self.right
        on = [resolve(a) == resolve(b) for a, b in zip(self.left_on, self.right_on, strict=True)]
        if self.where is not None:
            on.append(compile_expr(self.where, resolve))
        if not on:
            return df.crossJoin(right)
        if self.how == "left_mark" and self.where is not None:
            # whether a row has a match under the whole condition; null counts as none
            mark = lambda how, met: df.join(right, on, how).withColumn("mark", F.lit(met))
            return mark("left_semi", True).union(mark("left_anti", False))
        if self.how == "left_mark":
            keys = right.select(*map(resolve, self.right_on)).distinct().withColumn("mark", F.lit(True))
            names = [f"__key{i}" for i in range(len(self.right_on))]
            keys = keys.toDF(*names, "mark")
            met = df.join(keys, [resolve(a).eqNullSafe(F.col(n)) & resolve(a).isNotNull() for a, n in zip(self.left_on, names)], "left")
            return met.withColumn("mark", F.coalesce("mark", F.lit(False))).drop(*names)
        if self.how in SWAPPED:
            return right.join(df, on, SWAPPED[self.how])
        return df.join(right, on, self.how)
