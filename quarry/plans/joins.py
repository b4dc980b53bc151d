"""The join graph: which tables can be reached from which, and by which joins."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from quarry.errors import QueryError


@dataclass(frozen=True)
class Join:
    left: str
    right: str
    left_on: tuple[str, ...]
    right_on: tuple[str, ...]
    how: str = "left"
    direction: str = "rightonleft"

    def __post_init__(self):
        as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x)
        qualify = lambda t, c: c if "." in c else f"{t}.{c}"
        object.__setattr__(self, "left_on", tuple(qualify(self.left, c) for c in as_tuple(self.left_on)))
        object.__setattr__(self, "right_on", tuple(qualify(self.right, c) for c in as_tuple(self.right_on)))
        if self.how not in ("left", "inner") or self.direction not in ("both", "rightonleft"):
            raise QueryError(f"a join is left or inner, and both or rightonleft: {self}")
        if not self.left_on or len(self.left_on) != len(self.right_on):
            raise QueryError(f"a join needs as many keys on either side, one at least: {self}")

    @staticmethod
    def from_dict(d: dict) -> Join:
        return Join(**d)

    def reversed(self) -> Join:
        return Join(self.right, self.left, self.right_on, self.left_on, self.how, self.direction)


class JoinGraph:
    """Tables as nodes, joins as edges from the left to the right table (and back, if `both`)."""

    def __init__(self, joins: list[Join]):
        self.edges: dict[str, dict[str, Join]] = {}
        for j in joins:
            self.edges.setdefault(j.left, {}).setdefault(j.right, j)
            self.edges.setdefault(j.right, {})
            if j.direction == "both":
                self.edges[j.right].setdefault(j.left, j.reversed())
        self._reject_cycles()
        self.paths = {t: self._paths_from(t) for t in self.edges}

    @property
    def tables(self) -> list[str]:
        return sorted(self.edges)

    def _reject_cycles(self) -> None:
        """A path that returns to its start over three tables or more would make the joins ambiguous."""
        for start in self.edges:
            stack = [(start, (start,))]
            while stack:
                at, trail = stack.pop()
                for to in self.edges[at]:
                    if to == start and len(trail) >= 3:
                        raise QueryError(f"Cycle of length >= 3 in the joins: {' -> '.join((*trail, start))}")
                    if to > start and to not in trail:
                        stack.append((to, (*trail, to)))

    def _paths_from(self, start: str) -> dict[str, tuple[Join, ...]]:
        found: dict[str, tuple[Join, ...]] = {start: ()}
        queue = deque([start])
        while queue:
            at = queue.popleft()
            for to, join in self.edges[at].items():
                if to not in found:
                    found[to] = (*found[at], join)
                    queue.append(to)
        return found

    def find_path(self, start: str, to: str) -> tuple[Join, ...] | None:
        """The shortest path of joins, the first declared among equals; () to itself, None if there is none."""
        return () if start == to else self.paths.get(start, {}).get(to)

    def can_join(self, start: str, to: str) -> bool:
        return self.find_path(start, to) is not None

    def find_reachable_base(self, tables: list[str]) -> str:
        """The first of the tables from which all others can be reached."""
        for base in tables:
            if all(self.can_join(base, t) for t in tables):
                return base
        raise QueryError(f"no single base table can reach all tables: {', '.join(tables)}")

    def joins_for(self, base: str, tables: list[str]) -> list[Join]:
        """The joins that bring in the tables, each right table once, in the order in which they can be made."""
        out: dict[str, Join] = {}
        for t in tables:
            if (path := self.find_path(base, t)) is None:
                raise QueryError(f"table {t!r} can't be reached from {base!r}")
            for j in path:
                out.setdefault(j.right, j)
        return list(out.values())
