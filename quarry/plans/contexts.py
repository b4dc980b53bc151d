"""The three query payloads, with their defaults and checks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from enum import Enum

from quarry.errors import QueryError
from quarry.functions.columns import FilterSelection, allow
from quarry.functions.filters import filter_columns

#: Rows of an aggregate or view query unless it says otherwise.
DEFAULT_LIMIT = 10_000


def _limit(limit: int, offset: int) -> None:
    if limit <= 0:
        raise QueryError("limit must be > 0")
    if offset < 0:
        raise QueryError("offset must be >= 0")


def _known(names, known, label: str) -> None:
    for n in names:
        if n not in known:
            raise QueryError(f"{label}: {n}")


def _sorts(sorts, known, label: str) -> None:
    for column, direction in sorts:
        if direction not in ("asc", "desc"):
            raise QueryError(f"Invalid sort direction: {direction}")
        _known([column], known, label)


class Payload:
    """To and from dictionaries and JSON; reading goes through the constructor and its checks."""

    @classmethod
    def from_dict(cls, d: dict):
        return cls(**d)

    @classmethod
    def from_json(cls, text: str):
        return cls.from_dict(json.loads(text))

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict())


@dataclass(frozen=True)
class AggQuery(Payload):
    measures: list[str]
    filters: dict | None = field(default_factory=dict)
    groups: list[str] = field(default_factory=list)
    havings: dict | None = field(default_factory=dict)
    sorts: list[tuple[str, str]] = field(default_factory=list)
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    use_pre_agg: bool = True
    pre_agg_valid_secs: float | None = None

    def __post_init__(self):
        if not self.measures:
            raise QueryError("measures must not be empty")
        _limit(self.limit, self.offset)

    def check(self, columns: set[str], outputs: dict[str, list[str]]) -> None:
        """`outputs`: the columns that each registered measure gives."""
        _known(self.measures, outputs, "Unknown measure")
        _known(self.groups, columns, "Unknown group column")
        _known(filter_columns(self.filters), columns, "Unknown filter column")
        given = {*self.groups, *(c for m in self.measures for c in outputs[m])}
        _known(filter_columns(self.havings), given, "Invalid having column")
        _sorts(self.sorts, given, "Invalid sort column")

    def filter_for(self, *patterns: str) -> FilterSelection:
        """The query's filters as far as a measure honours them."""
        return allow(patterns or "*", self.filters or {})

    def groups_for(self, *patterns: str, include=()):
        return allow(patterns or "*", list(self.groups), include)


@dataclass(frozen=True)
class ViewQuery(Payload):
    columns: list[str]
    filters: dict | None = field(default_factory=dict)
    sorts: list[tuple[str, str]] = field(default_factory=list)
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    def __post_init__(self):
        if not self.columns:
            raise QueryError("columns must not be empty")
        _limit(self.limit, self.offset)
        for c in self.columns:
            if "." not in c:
                raise QueryError(f"columns must be table-qualified: {c}")

    def check(self, columns: set[str]) -> None:
        _known(self.columns, columns, "Unknown column")
        _known(filter_columns(self.filters), columns, "Unknown filter column")
        _sorts(self.sorts, self.columns, "Sort column not in selected columns")


class ColumnValuesMode(Enum):
    DISTINCT = "distinct"
    RANGE = "range"


@dataclass(frozen=True)
class ColumnValuesQuery(Payload):
    column: str
    mode: ColumnValuesMode = ColumnValuesMode.DISTINCT
    use_pre_agg: bool = True
    pre_agg_valid_secs: float | None = None

    def __post_init__(self):
        object.__setattr__(self, "mode", ColumnValuesMode(self.mode))
        table, dot, column = self.column.partition(".")
        if not dot or "." in column:
            raise QueryError(f"column must be in 'table_name.column_name' format: {self.column}")
        for what, part in (("table", table), ("column", column)):
            if not part or not part.replace("_", "a").isalnum():
                raise QueryError(f"invalid {what} name: {part!r}")

    def to_dict(self) -> dict:
        return asdict(self) | {"mode": self.mode.value}
