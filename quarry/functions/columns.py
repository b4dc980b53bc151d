"""Table-qualified columns and the scoping of measures by `allow` and `exclude`."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from quarry.errors import QueryError
from quarry.functions.expr import Expr

_PART = re.compile(r"[A-Za-z0-9_]+")


@dataclass(frozen=True)
class TableColumn:
    table: str
    column: str

    @staticmethod
    def of(text: str) -> TableColumn:
        table, dot, column = text.partition(".")
        if not dot or not _PART.fullmatch(table) or not _PART.fullmatch(column):
            raise QueryError(f"column must be in 'table_name.column_name' format: {text!r}")
        return TableColumn(table, column)

    def __str__(self) -> str:
        return f"{self.table}.{self.column}"


def is_qualified(text: str) -> bool:
    table, dot, column = text.partition(".")
    return bool(dot and _PART.fullmatch(table) and _PART.fullmatch(column))


@dataclass(frozen=True)
class Pattern:
    """`*`, `table.*` or `table.column`."""

    table: str
    column: str

    @staticmethod
    def of(text: str) -> Pattern:
        if text == "*":
            return Pattern("*", "*")
        table, dot, column = text.partition(".")
        if not dot or not all(p == "*" or _PART.fullmatch(p) for p in (table, column)):
            raise QueryError(f"pattern must be '*', 'table.*' or 'table.column': {text!r}")
        return Pattern(table, column)

    def matches(self, name: str) -> bool:
        table, _, column = name.partition(".")
        return self.table == "*" or self.table == table and self.column in ("*", column)


@dataclass(frozen=True)
class Scope:
    """One call of `allow` or `exclude`: which columns a measure honours."""

    keep: bool
    patterns: tuple[Pattern, ...]
    include: tuple[str, ...] = ()

    def admits(self, name: str) -> bool:
        return is_qualified(name) and any(p.matches(name) for p in self.patterns) == self.keep


@dataclass(frozen=True)
class ColumnSelection:
    """Group columns that a scope admitted."""

    names: tuple[str, ...]
    scope: Scope


@dataclass(frozen=True)
class FilterSelection:
    """A filter of which a scope admitted parts; None: nothing is left of it."""

    predicate: Expr | None
    scope: Scope


def _scoped(keep: bool, patterns: str | Iterable[str], context, include: Iterable[str]):
    from quarry.functions.filters import filter_tree, prune

    patterns = [patterns] if isinstance(patterns, str) else patterns
    scope = Scope(keep, tuple(map(Pattern.of, patterns)), tuple(str(TableColumn.of(c)) for c in include))
    if context is None or isinstance(context, dict):
        return FilterSelection(prune(filter_tree(context), scope.admits), scope)
    admitted = {c for c in context if scope.admits(c)}
    return ColumnSelection(tuple(sorted(admitted | set(scope.include))), scope)


def allow(patterns: str | Iterable[str], context, include: Iterable[str] = ()) -> ColumnSelection | FilterSelection:
    """The part of `context` whose columns match: of a list of columns (with `include`, sorted, once each) or of a filter."""
    return _scoped(True, patterns, context, include)


def exclude(patterns: str | Iterable[str], context, include: Iterable[str] = ()) -> ColumnSelection | FilterSelection:
    """The part of `context` whose columns don't match; see `allow`."""
    return _scoped(False, patterns, context, include)
