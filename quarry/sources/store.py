"""Versions of pre-aggregations: immutable Parquet tables, a pointer to the current one, leases and reclaiming."""

from __future__ import annotations

import json
import re
import threading
import time
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quarry.functions.expr import Agg, bare
from quarry.plans.joins import Join
from quarry.sources.files import Files
from quarry.sources.preagg import METADATA, NEEDED, PreAggregation, servable

#: Seconds for which a superseded version, and a file that nothing names, stay.
RETIRED_GRACE, ORPHAN_GRACE = 60.0, 3600.0


@dataclass(frozen=True)
class Version:
    name: str
    millis: int
    path: str
    row_count: int
    written_at: float
    columns: dict[tuple[str, str | None], str] = field(compare=False)  # (column, component): stored name
    base: str = ""
    edges: tuple[Join, ...] = ()
    keeps_rows: tuple[bool, ...] = ()  # of each edge: it neither drops nor repeats rows
    schema: StructType = field(default=None, compare=False)

    def covers(self, keys: set[str], aggs: list[Agg], base: str, edges: list[Join]) -> bool:
        """Whether the version gives the same answer as the tables: all keys and components are stored, and it was made
        from the same base by the same joins, any further ones keeping the rows as they are."""
        if base != self.base or not all((k, None) in self.columns for k in keys):
            return False
        if not all(servable(a) and all((bare(a.of), p) in self.columns for p in NEEDED[a.fn]) for a in aggs):
            return False
        return set(edges) <= set(self.edges) and all(keeps for e, keeps in zip(self.edges, self.keeps_rows) if e not in edges)

    def to_json(self) -> str:
        return json.dumps({
            "name": self.name, "millis": self.millis, "path": self.path, "row_count": self.row_count, "written_at": self.written_at, "base": self.base,
            "edges": [e.__dict__ for e in self.edges], "keeps_rows": self.keeps_rows, "schema": self.schema.jsonValue(),
        })

    @staticmethod
    def from_json(text: str) -> Version:
        d = json.loads(text)
        schema = StructType.fromJson(d.pop("schema"))
        edges = tuple(Join.from_dict(e) for e in d.pop("edges"))
        return Version(**d | {"edges": edges, "keeps_rows": tuple(d["keeps_rows"]), "schema": schema, "columns": identities(schema)})


def identities(schema: StructType) -> dict[tuple[str, str | None], str]:
    """What each stored column is, from its metadata; a column without any is taken by its name."""
    out = {}
    for f in schema.fields:
        if tag := f.metadata.get(METADATA):
            out[tag["column"], tag.get("component")] = f.name
        else:
            out[f.name.replace("__", ".", 1), None] = f.name
    return out


@dataclass
class Reclaimed:
    deleted: list[str] = field(default_factory=list)
    in_use: list[str] = field(default_factory=list)
    in_grace: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


class PreAggStore:
    def __init__(self, spark: SparkSession, folder: str, definitions: dict[str, PreAggregation]):
        self.spark, self.folder, self.definitions = spark, folder.rstrip("/"), definitions
        self.files = Files(spark)
        self.retired_grace, self.orphan_grace = RETIRED_GRACE, ORPHAN_GRACE
        self.current: dict[str, Version] = {}
        self.retired: list[tuple[Version, float]] = []
        self.leases: Counter[str] = Counter()
        self.lock = threading.RLock()
        self._load()

    def _load(self) -> None:
        """Takes up the versions that pointers name; a pointer that can't be read or names nothing counts as none."""
        for name in self.definitions:
            try:
                version = Version.from_json(self.files.read(f"{self.folder}/{name}.current"))
            except Exception:  # Hadoop's errors come wrapped; a broken pointer must not keep the model from opening
                continue
            if self.files.exists(version.path):
                self.current[name] = version

    def read(self, version: Version) -> DataFrame:
        return self.spark.read.schema(version.schema).parquet(version.path)

    def write(self, name: str, frame: DataFrame, base: str, edges: list[Join], keeps_rows: list[bool]) -> Version:
        with self.lock:
            millis = int(time.time() * 1000)
            while self.files.exists(path := f"{self.folder}/{name}.{millis}.parquet"):
                millis += 1
        frame.write.parquet(path)
        schema = frame.schema
        rows = self.spark.read.schema(schema).parquet(path).count()
        version = Version(name, millis, path, rows, time.time(), identities(schema), base, tuple(edges), tuple(keeps_rows), schema)
        self.files.replace(f"{self.folder}/{name}.current", version.to_json())
        with self.lock:
            old = self.current.get(name)
            self.current[name] = version
            if old and old.path != version.path:
                self.retired.append((old, time.time()))
        return version

    def versions_where(self, admits: Callable[[Version], bool], most_age: float | None) -> list[Version]:
        """Current versions that are fresh enough and admitted, the fewest rows first."""
        now = time.time()
        with self.lock:
            fresh = [v for v in self.current.values() if most_age is None or now - v.written_at <= most_age]
        return sorted(filter(admits, fresh), key=lambda v: (v.row_count, v.name))

    def lease(self, path: str, by: int = 1) -> None:
        with self.lock:
            self.leases[path] += by

    def reclaim(self) -> Reclaimed:
        """Deletes superseded versions that no query reads, and files of known names that nothing names, after their grace."""
        out, now = Reclaimed(), time.time()
        with self.lock:
            kept = []
            for version, since in self.retired:
                if now - since < self.retired_grace:
                    out.in_grace.append(version.path)
                elif self.leases[version.path] > 0:
                    out.in_use.append(version.path)
                else:
                    self._delete(version.path, out)
                    continue
                kept.append((version, since))
            self.retired = kept
            named = {v.path.rpartition("/")[2] for v in (*self.current.values(), *(v for v, _ in kept))}
            known = "|".join(map(re.escape, self.definitions))
            for file, modified in self.files.names(self.folder):
                if file not in named and re.fullmatch(rf"({known})\.(\d+\.parquet|current\.tmp)", file) and now - modified / 1000 >= self.orphan_grace:
                    self._delete(f"{self.folder}/{file}", out)
        return out

    def _delete(self, path: str, out: Reclaimed) -> None:
        try:
            self.files.delete(path)
            out.deleted.append(path)
        except Exception as e:  # Hadoop's errors come wrapped; what stays is reported and tried again next time
            out.errors.append(f"{path}: {e}")


@dataclass
class LeaseScope:
    """What one query pins while it is built and read."""

    store: PreAggStore | None
    most_age: float | None = None
    paths: list[str] = field(default_factory=list)

    def pin(self, version: Version) -> None:
        self.paths.append(version.path)
        self.store.lease(version.path)

    def release(self) -> None:
        while self.paths:
            self.store.lease(self.paths.pop(), -1)


active: ContextVar[LeaseScope | None] = ContextVar("active", default=None)


@contextmanager
def lease_scope(store: PreAggStore | None, most_age: float | None = None) -> Iterator[LeaseScope]:
    """Versions scanned inside are leased until the end. A scope inside another is its own; the outer one then goes on."""
    scope = LeaseScope(store, most_age)
    token = active.set(scope)
    try:
        yield scope
    finally:
        active.reset(token)
        scope.release()


__all__ = ["LeaseScope", "PreAggStore", "Reclaimed", "Version", "active", "identities", "lease_scope"]
