"""The recorder: a lazy chain of operations that sees what it uses before a frame is built."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from quarry.errors import QueryError
from quarry.functions.columns import ColumnSelection, FilterSelection, Scope
from quarry.functions.expr import Agg, Alias, Col, Expr, aggregates, col, columns, lit, outside_aggregates, output_name, rewrite
from quarry.functions.filters import prune
from quarry.operators import ops
from quarry.operators.measures import AggFrame

if TYPE_CHECKING:
    from quarry.plans.model import DataModel


class Recorder:
    """Operations over a table. Other tables come in where a column of theirs is used; `build` makes the joins.

    After `aggregate` nothing can be recorded. A measure returns a recorder that ends with it.
    """

    def __init__(self, model: DataModel, table: str, use_pre_agg: bool = True):
        self.model, self.table, self.use_pre_agg = model, table, use_pre_agg
        self.ops: list[ops.Operation] = []
        self.scopes: list[Scope] = []
        self.groups: tuple[Expr, ...] | None = None
        self.aggs: tuple[Expr, ...] = ()

    def _record(self, op: ops.Operation) -> Recorder:
        if self.groups is not None:
            raise QueryError("nothing can follow aggregate()")
        self.ops.append(op)
        return self

    def filter(self, predicate: Expr | FilterSelection | None) -> Recorder:
        """Keeps rows; comparisons with tables that can't be reached from this one are left out."""
        if isinstance(predicate, ColumnSelection):
            raise QueryError("filter() takes a filter, not a list of columns")
        if isinstance(predicate, FilterSelection):
            self.scopes.append(predicate.scope)
            predicate = predicate.predicate
        predicate = prune(predicate, lambda c: "." not in c or self.model.can_join(self.table, c.partition(".")[0]))
        return self if predicate is None else self._record(ops.Filter(predicate))

    def with_columns(self, *exprs: Expr, **named: Expr) -> Recorder:
        return self._record(ops.WithColumns((*exprs, *(lit(e).alias(n) for n, e in named.items()))))

    def drop_columns(self, *names: str) -> Recorder:
        return self._record(ops.Drop(names))

    def sort(self, *by: str | Expr) -> Recorder:
        return self._record(ops.SortRows(tuple(map(col, by))))

    def limit(self, skip: int = 0, fetch: int | None = None) -> Recorder:
        return self._record(ops.Limit(skip, fetch))

    def distinct(self) -> Recorder:
        return self._record(ops.Distinct())

    def distinct_on(self, on, select, sort=()) -> Recorder:
        return self._record(ops.DistinctOn(*(tuple(map(col, x)) for x in (on, select, sort))))

    def union(self, other: DataFrame | Recorder) -> Recorder:
        return self._record(ops.Union(other := _frame(other), False, id(other)))

    def union_distinct(self, other: DataFrame | Recorder) -> Recorder:
        return self._record(ops.Union(other := _frame(other), True, id(other)))

    def window(self, *exprs: Expr) -> Recorder:
        return self._record(ops.WindowColumns(exprs))

    def join(self, right: DataFrame | Recorder, how: str = "inner", left_on=(), right_on=(), where: Expr | None = None) -> Recorder:
        """Joins a frame; its columns go by the names of its alias."""
        return self._record(ops.JoinFrame(right := _frame(right), how, tuple(left_on), tuple(right_on), where, id(right)))

    def aggregate(self, groups, aggs) -> Recorder:
        if isinstance(groups, FilterSelection):
            raise QueryError("aggregate() takes a list of columns, not a filter")
        if isinstance(groups, ColumnSelection):
            self.scopes.append(groups.scope)
            groups = groups.names
        if self.groups is not None:
            raise QueryError("nothing can follow aggregate()")
        self.groups = tuple(map(col, groups))
        self.aggs = tuple(aggs) if isinstance(aggs, list | tuple) else (aggs,)
        return self

    # what has been seen

    @property
    def aliases(self) -> dict[str, str]:
        """Names that with_columns gave to a column, however often renamed, to that column."""
        out: dict[str, str] = {}
        for op in self.ops:
            if isinstance(op, ops.WithColumns):
                out |= {n: out.get(s, s) for n, s in op.renames().items() if n != s}
        return out

    def _source(self, e: Expr) -> Expr:
        aliases = self.aliases
        return rewrite(e, lambda x: Col(aliases[x.name]) if isinstance(x, Col) and x.name in aliases else None)

    @property
    def non_agg_columns(self) -> list[str]:
        """Columns used outside aggregates, by their source."""
        used = [c for op in self.ops if not isinstance(op, ops.SortRows) for c in op.reads()]
        used += [c for g in self.groups or () for c in columns(g)] + [c for a in self.aggs for c in outside_aggregates(a)]
        return list(dict.fromkeys(self.aliases.get(c, c) for c in used))

    @property
    def source_aggregates(self) -> list[Agg]:
        return [a for e in self.aggs for a in aggregates(self._source(e))]

    @property
    def pre_agg_allowed(self) -> bool:
        """Whether a rollup may stand for the rows: no operation needs single rows, and all aggregates can be put together."""
        return self.use_pre_agg and bool(self.source_aggregates) and all(op.keeps_pre_agg(self.model.type_of) for op in self.ops)

    def needed_columns(self) -> list[str]:
        """Table-qualified columns that the chain uses, for the joins."""
        used = [c for op in self.ops for c in (op.joined() if isinstance(op, ops.WithColumns) else op.reads())]
        used += [c for e in (*(self.groups or ()), *self.aggs) for c in columns(e)]
        if frames := [op for op in self.ops if isinstance(op, ops.JoinFrame)]:
            # what an explicitly joined frame brings isn't joined again
            brought = {c.partition(".")[0] for op in frames for c in op.right_on} | {t for c in used if (t := c.partition(".")[0]) not in self.model.tables}
            used = [c for c in used if c.partition(".")[0] not in brought]
        return [c for c in dict.fromkeys(used) if "." in c]

    @property
    def outputs(self) -> list[str]:
        return [output_name(e) for e in self.aggs]

    def build(self) -> DataFrame | AggFrame:
        """The frame that the operations give, or the aggregate to be taken over it."""
        planned = self.model.plan_scan(self)
        df, resolve = planned.frame, planned.resolve
        for op in self.ops:
            if planned.version is not None and isinstance(op, ops.SortRows | ops.WithColumns | ops.Drop):
                continue  # of a rollup, renamed columns are read by their source; order and width of rows don't matter
            op = ops.Filter(self._source(op.predicate)) if planned.version is not None and isinstance(op, ops.Filter) else op
            df = op.apply(df, resolve)
        if self.groups is None:
            return df
        final = self._source if planned.version is not None else lambda e: e
        groups = tuple(map(output_name, self.groups))
        aggs = tuple(a if isinstance(a, Alias) else Alias(a, output_name(a)) for a in self.aggs)
        # frames are told apart by where they are held, so the result holds them
        key = (planned.key, tuple(map(repr, self.ops)), groups, tuple(map(repr, self.groups)))
        return AggFrame(df, groups, tuple(final(g.of if isinstance(g, Alias) else g) for g in self.groups), tuple(final(a) for a in aggs), resolve, planned.aggregate, key, tuple(self.scopes), planned.version, tuple(self.ops))


def _frame(x: DataFrame | Recorder) -> DataFrame:
    if isinstance(x, Recorder):
        x = x.build()
    return x.to_df() if isinstance(x, AggFrame) else x
