"""The data model: tables, joins, measures and pre-aggregations, and the queries over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.errors import QueryError
from quarry.functions.columns import Scope
from quarry.functions.expr import Agg, Alias, Resolver, bare, compile_expr, flat, qualified
from quarry.functions.filters import filter_columns, filter_tree
from quarry.operators.measures import AggFrame, full_join, merged, normalize_schema
from quarry.plans.contexts import AggQuery, ColumnValuesMode, ColumnValuesQuery, ViewQuery
from quarry.plans.joins import Join, JoinGraph
from quarry.plans.recorder import Recorder
from quarry.sources.preagg import PreAggregation, component, rolled_up, tagged
from quarry.sources.store import LeaseScope, PreAggStore, Reclaimed, Version, active, lease_scope

Query = AggQuery | ViewQuery | ColumnValuesQuery
Measure = Callable[["DataModel", AggQuery], Recorder]


@dataclass(frozen=True)
class MeasureMetadata:
    outputs: list[str]
    aggregates: list[tuple[str | None, str]]
    scopes: tuple[Scope, ...]


@dataclass(frozen=True)
class PlannedScan:
    """The rows that a chain starts from, and how its columns and aggregates are read from them."""

    frame: DataFrame
    resolve: Resolver
    aggregate: Callable[[Agg], Column] | None
    key: tuple
    version: Version | None = None


#: What each session's catalog holds: (tables, paths of rollups).
_published: WeakKeyDictionary[SparkSession, tuple] = WeakKeyDictionary()


class DataModel:
    """Queries name measures, groups and filters; the model finds the joins, shares scans and uses rollups.

    `execute` returns a lazy frame. A rollup version that it reads stays for the store's grace after being superseded;
    `query` and `collect` hold it for as long as they need it.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], joins: list[Join] = (), pre_aggs: list[PreAggregation] = (), pre_agg_path: str | None = None):
        self.spark, self.tables = spark, dict(tables)
        self.graph = JoinGraph(list(joins))
        for t in self.graph.tables:
            if t not in self.tables:
                raise QueryError(f"a join names the unknown table {t!r}")
        definitions: dict[str, PreAggregation] = {}
        for p in pre_aggs:
            if definitions.setdefault(p.name, p) is not p:
                raise QueryError(f"pre-aggregation {p.name!r} is defined twice")
        self.store = PreAggStore(spark, pre_agg_path, definitions) if definitions and pre_agg_path else None
        self.measures: dict[str, Measure] = {}
        self.metadata: dict[str, MeasureMetadata] = {}
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    # tables

    def table(self, name: str, use_pre_agg: bool = True) -> Recorder:
        self._table(name)
        return Recorder(self, name, use_pre_agg)

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise QueryError(f"unknown table: {name}")
        return self.tables[name]

    def scan_table(self, name: str) -> DataFrame:
        return self._table(name).alias(name)

    def can_join(self, start: str, to: str) -> bool:
        return self.graph.can_join(start, to)

    def schemas(self) -> list[tuple[str, StructType]]:
        return [(n, self.tables[n].schema) for n in sorted(self.tables)]

    def known_columns(self) -> set[str]:
        return {c if c.startswith(f"{t}.") else f"{t}.{c}" for t, df in self.tables.items() for c in df.columns}

    def type_of(self, name: str) -> str | None:
        table, _, column = name.partition(".")
        return dict(self.tables[table].dtypes).get(column) if table in self.tables else None

    def _joined(self, base: str, joins: list[Join]) -> DataFrame:
        df = self.scan_table(base)
        for j in joins:
            on = [qualified(a) == qualified(b) for a, b in zip(j.left_on, j.right_on)]
            df = df.join(self.scan_table(j.right), on, j.how)
        return df

    # measures

    def add_measure(self, name: str, measure: Measure) -> None:
        """Registers a measure after a dry run, which plans but reads nothing."""
        if name in self.measures:
            raise QueryError(f"measure {name!r} is already registered")
        recorder = self._recorded(measure, AggQuery([name]))
        aggs = [(bare(a.of), a.fn) for a in recorder.source_aggregates]
        self.metadata[name] = MeasureMetadata([e.name for e in recorder.aggs if isinstance(e, Alias)], aggs, tuple(recorder.scopes))
        self.measures[name] = measure

    def _recorded(self, measure: Measure, query: AggQuery) -> Recorder:
        recorder = measure(self, query)
        if not isinstance(recorder, Recorder) or recorder.groups is None:
            raise QueryError("measure must end with aggregate()")
        recorder.use_pre_agg = recorder.use_pre_agg and query.use_pre_agg
        return recorder

    def measure_metadata(self, name: str) -> MeasureMetadata:
        if name not in self.metadata:
            raise QueryError(f"Unknown measure: {name}")
        return self.metadata[name]

    # planning

    def plan_scan(self, recorder: Recorder) -> PlannedScan:
        """A rollup that gives the same answer, the smallest first, or the table with the joins that the chain needs."""
        base = recorder.table
        tables = sorted({c.partition(".")[0] for c in recorder.needed_columns()} - {base})
        joins = self.graph.joins_for(base, tables)
        if self.store and recorder.groups is not None and recorder.pre_agg_allowed:
            keys, aggs = set(recorder.non_agg_columns), recorder.source_aggregates
            scope = active.get()
            for version in self.store.versions_where(lambda v: v.covers(keys, aggs, base, joins), scope.most_age if scope else None):
                if self.store.files.exists(version.path):
                    return self.scan_pre_agg(version)
        return PlannedScan(self._joined(base, joins), qualified, None, (base, tuple(joins)))

    def scan_pre_agg(self, version: Version) -> PlannedScan:
        if (scope := active.get()) and scope.store is self.store:
            scope.pin(version)
        stored = lambda c, part=None: F.col(version.columns[c, part])
        return PlannedScan(self.store.read(version), stored, lambda a: rolled_up(a, lambda part: stored(bare(a.of), part)), ("pre_agg", version.path), version)

    def build(self, query: Query | dict) -> DataFrame:
        match _typed(query):
            case AggQuery() as q:
                return self._aggregate_query(q)
            case ViewQuery() as q:
                return self._view_query(q)
            case q:
                return self._column_values(q)

    def _aggregate_query(self, q: AggQuery) -> DataFrame:
        q.check(self.known_columns(), {n: m.outputs for n, m in self.metadata.items()})
        frames = [self._recorded(self.measures[m], q).build() for m in dict.fromkeys(q.measures)]
        if any(f.groups != frames[0].groups for f in frames):
            raise QueryError("incompatible group-by columns across measures: " + "; ".join(f"{m}: {', '.join(f.groups)}" for m, f in zip(dict.fromkeys(q.measures), frames)))
        first, *rest = (f.to_df() for f in merged(frames))
        for right in rest:
            first = full_join(first, right, frames[0].groups)
        return _finished(first, q, q.havings)

    def _view_query(self, q: ViewQuery) -> DataFrame:
        q.check(self.known_columns())
        tables = sorted({c.partition(".")[0] for c in (*q.columns, *filter_columns(q.filters))})
        base = self.graph.find_reachable_base(tables)
        df = self._joined(base, self.graph.joins_for(base, [t for t in tables if t != base]))
        if (tree := filter_tree(q.filters)) is not None:
            df = df.filter(compile_expr(tree, qualified))
        return _finished(normalize_schema(df, q.columns), q, None)

    def _column_values(self, q: ColumnValuesQuery) -> DataFrame:
        table, _, column = q.column.partition(".")
        if column not in self._table(table).columns:
            raise QueryError(f"unknown column: {q.column}")
        distinct = q.mode is ColumnValuesMode.DISTINCT
        ends = lambda low, high: (F.min(low).alias("min"), F.max(high).alias("max"))
        if q.use_pre_agg and self.store:
            # only rollups of the column's own table have all its values and no others
            has = lambda *parts: lambda v: v.base == table and all((q.column, p) in v.columns for p in parts) and all(v.keeps_rows)
            for v in self.store.versions_where(has(None), q.pre_agg_valid_secs):
                if not self.store.files.exists(v.path):
                    continue
                scan = self.scan_pre_agg(v)
                key = scan.resolve(q.column)
                return scan.frame.select(key.alias(q.column)).distinct() if distinct else scan.frame.agg(*ends(key, key))
            for v in [] if distinct else self.store.versions_where(has("min", "max"), q.pre_agg_valid_secs):
                if not self.store.files.exists(v.path):
                    continue
                scan = self.scan_pre_agg(v)
                return scan.frame.agg(*ends(F.col(v.columns[q.column, "min"]), F.col(v.columns[q.column, "max"])))
        df = self.scan_table(table)
        c = qualified(q.column)
        return df.select(c.alias(q.column)).distinct() if distinct else df.agg(*ends(c, c))

    # running

    def execute(self, query: Query | dict) -> DataFrame:
        """The lazy result. Rollups that it reads aren't held; see `query`."""
        with lease_scope(self.store, getattr(_typed(query), "pre_agg_valid_secs", None)):
            return self.build(query)

    @contextmanager
    def query(self, query: Query | dict) -> Iterator[DataFrame]:
        """The result, whose rollups are held until the end of the block."""
        with lease_scope(self.store, getattr(_typed(query), "pre_agg_valid_secs", None)):
            yield self.build(query)

    def collect(self, query: Query | dict) -> list[Row]:
        with self.query(query) as df:
            return df.collect()

    def explain(self, query: Query | dict, mode: str = "formatted") -> str:
        df = self.execute(query)
        mode = self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
        return df._jdf.queryExecution().explainString(mode)

    def display_graphviz(self, query: Query | dict) -> str:
        """The analysed plan in DOT: a node for each operator, an edge from each to its inputs."""
        lines, trail = [], []
        for i, line in enumerate(self.execute(query)._jdf.queryExecution().analyzed().toString().rstrip().split("\n")):
            text = line.lstrip(" :+-|")
            depth = len(line) - len(text)
            while trail and trail[-1][0] >= depth:
                trail.pop()
            label = text.replace("\\", "\\\\").replace('"', '\\"')
            lines.append(f'  n{i} [shape=box, label="{label}"];')
            if trail:
                lines.append(f"  n{trail[-1][1]} -> n{i};")
            trail.append((depth, i))
        return "digraph plan {\n" + "\n".join(lines) + "\n}"

    def sql(self, statement: str, scope: LeaseScope | None = None) -> DataFrame:
        """Spark SQL over the tables, the written rollups as pre_agg.<name>, and information_schema.tables."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        self._publish_catalog()
        df = self.spark.sql(statement)
        if self.store and (scope := scope or active.get()):
            files = df.inputFiles()
            for v in list(self.store.current.values()):
                if any(v.path.removeprefix("file:").lstrip("/") in f for f in files):
                    scope.pin(v)
        return df

    def _publish_catalog(self) -> None:
        """Makes the session's catalog this model's, unless it is already."""
        held = (tuple(sorted(self.tables)), tuple(sorted((n, v.path) for n, v in self.store.current.items())) if self.store else ())
        if _published.get(self.spark) == held:
            return
        self.spark.sql("CREATE DATABASE IF NOT EXISTS pre_agg")
        self.spark.sql("CREATE DATABASE IF NOT EXISTS information_schema")
        written = sorted(self.store.current) if self.store else []
        for row in self.spark.sql("SHOW VIEWS IN pre_agg").collect():
            if not row["isTemporary"] and row["viewName"] not in written:
                self.spark.sql(f"DROP VIEW IF EXISTS pre_agg.`{row['viewName']}`")
        for name in written:
            path = self.store.current[name].path
            self.spark.sql(f"CREATE OR REPLACE VIEW pre_agg.`{name}` AS SELECT * FROM parquet.`{path}`")
        listed = [("public", t, "BASE TABLE") for t in sorted(self.tables)] + [("pre_agg", n, "VIEW") for n in written]
        quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        rows = ", ".join(f"({', '.join(map(quoted, r))})" for r in listed)
        self.spark.sql(f"CREATE OR REPLACE VIEW information_schema.tables AS SELECT * FROM VALUES {rows} AS t(table_schema, table_name, table_type)")
        _published[self.spark] = held

    # pre-aggregations

    def _own_store(self) -> PreAggStore:
        if not self.store:
            raise QueryError("no pre-aggregations registered")
        return self.store

    def write_pre_aggs(self, names: list[str] | None = None) -> Reclaimed:
        """Writes new versions of the named rollups (all, if None), then reclaims superseded ones."""
        store = self._own_store()
        for name in store.definitions if names is None else names:
            if name not in store.definitions:
                raise QueryError(f"pre-aggregation {name!r} not found")
        for name in store.definitions if names is None else names:
            self._write_pre_agg(store.definitions[name])
        return store.reclaim()

    def _write_pre_agg(self, p: PreAggregation) -> None:
        base = self.graph.find_reachable_base(p.tables) if len(p.tables) > 1 else p.tables[0]
        joins = self.graph.joins_for(base, [t for t in p.tables if t != base])
        groups = [tagged(qualified(c), c, None) for c in p.group_by]
        parts = [tagged(component(part, qualified(c)), c, part) for c, part in p.stored() if part]
        frame = self._joined(base, joins).groupBy(*groups).agg(*parts)
        self.store.write(p.name, frame, base, joins, [j.how == "left" and self._unique(j) for j in joins])

    def _unique(self, j: Join) -> bool:
        """Whether no row of the join's left side can meet two of its right side."""
        keys = [qualified(c) for c in j.right_on]
        return self.scan_table(j.right).groupBy(*keys).count().filter("count > 1").limit(1).isEmpty()

    def reclaim(self) -> Reclaimed:
        return self._own_store().reclaim()

    def set_pre_agg_retired_grace(self, seconds: float) -> None:
        self._own_store().retired_grace = seconds

    def set_pre_agg_orphan_grace(self, seconds: float) -> None:
        self._own_store().orphan_grace = seconds


def _typed(query: Query | dict) -> Query:
    """A payload as what its keys say it is."""
    if not isinstance(query, dict):
        return query
    kind = AggQuery if "measures" in query else ViewQuery if "columns" in query else ColumnValuesQuery
    return kind.from_dict(query)


def _finished(df: DataFrame, q: AggQuery | ViewQuery, havings: dict | None) -> DataFrame:
    """Havings, sorts (nulls first in both directions), offset and limit over the flat columns."""
    if (tree := filter_tree(havings)) is not None:
        df = df.filter(compile_expr(tree, flat))
    if q.sorts:
        df = df.orderBy(*(flat(c).desc_nulls_first() if d == "desc" else flat(c).asc_nulls_first() for c, d in q.sorts))
    return (df.offset(q.offset) if q.offset else df).limit(q.limit)


__all__ = ["AggFrame", "AggQuery", "ColumnValuesQuery", "DataModel", "Join", "PreAggregation", "Version", "ViewQuery"]
