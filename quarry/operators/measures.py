"""Aggregates at the root of measures: fusing those over one input, and joining the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import QueryError
from quarry.functions.columns import Scope
from quarry.functions.expr import Agg, Alias, Expr, Resolver, compile_expr, flat, output_name, qualified


@dataclass(frozen=True)
class AggFrame:
    """A frame with the groups and aggregates that are to be taken over it."""

    frame: DataFrame
    groups: tuple[str, ...]
    group_exprs: tuple[Expr, ...]
    aggs: tuple[Expr, ...]
    resolve: Resolver
    aggregate: Callable[[Agg], Column] | None
    key: tuple  # equal for equal inputs and groups
    scopes: tuple[Scope, ...] = ()
    version: object = None
    held: tuple = field(default=(), compare=False)
    outputs: tuple[str, ...] = field(default=())

    def to_df(self) -> DataFrame:
        """Flat: each column is named as the query names it, `table.column` with the dot."""
        groups = [compile_expr(e, self.resolve).alias(n) for n, e in zip(self.groups, self.group_exprs)]
        aggs = [compile_expr(e.of if isinstance(e, Alias) else e, self.resolve, self.aggregate).alias(output_name(e)) for e in self.aggs]
        return self.frame.groupBy(*groups).agg(*aggs) if groups else self.frame.agg(*aggs)


def merged(frames: list[AggFrame]) -> list[AggFrame]:
    """Frames over the same input and groups become one, which takes all their aggregates in one pass."""
    by_key: dict[tuple, AggFrame] = {}
    for f in frames:
        if (old := by_key.get(f.key)) is None:
            by_key[f.key] = f
            continue
        names = {output_name(e): e for e in old.aggs}
        for e in f.aggs:
            if names.setdefault(output_name(e), e) != e:
                raise QueryError(f"two measures give different columns the name {output_name(e)}")
        by_key[f.key] = AggFrame(**{**old.__dict__, "aggs": tuple(names.values())})
    return list(by_key.values())


def normalize_schema(frame: DataFrame, names: list[str]) -> DataFrame:
    """Table-qualified columns as flat ones, each named `table.column`."""
    return frame.select(*(qualified(n).alias(n) for n in names))


def full_join(left: DataFrame, right: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Rows of both by group; null groups meet. Of columns with one name the left one stays. Without groups both have one row."""
    new = [c for c in right.columns if c not in left.columns]
    if not groups:
        return left.crossJoin(right.select(*map(flat, new)))
    keys = [f"__right{i}" for i in range(len(groups))]
    side = right.select(*(flat(g).alias(k) for g, k in zip(groups, keys)), *map(flat, new))
    on = reduce(lambda a, b: a & b, (flat(g).eqNullSafe(F.col(k)) for g, k in zip(groups, keys)))
    both = left.join(side, on, "full")
    return both.select(
        *(F.coalesce(flat(g), F.col(k)).alias(g) for g, k in zip(groups, keys)),
        *(flat(c) for c in left.columns if c not in groups), *map(flat, new),
    )
