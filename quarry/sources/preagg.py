"""Pre-aggregations: what they store, what they can answer, and how an aggregate is read from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.errors import QueryError
from quarry.functions.columns import TableColumn
from quarry.functions.expr import Agg, bare

# fixed values: what a definition may ask for, and the components that each needs
ASKED = {"sum": ("sum",), "count": ("count",), "min": ("min",), "max": ("max",), "mean": ("sum", "count"), "std": ("sum", "sumsq", "count"), "var": ("sum", "sumsq", "count")}
# fixed values: the components from which an aggregate can be put together
NEEDED = {
    "sum": ("sum",), "count": ("count",), "min": ("min",), "max": ("max",), "avg": ("sum", "count"), "mean": ("sum", "count"),
    **dict.fromkeys(("stddev", "stddev_samp", "std", "stddev_pop", "variance", "var", "var_samp", "var_pop"), ("sum", "sumsq", "count")),
}
METADATA = "quarry"


def physical(column: str, component: str | None = None) -> str:
    """Name of a stored column. It isn't one-to-one, so a column's metadata says what it is."""
    return column.replace(".", "__") + (f"__{component}" if component else "")


@dataclass(frozen=True)
class PreAggregation:
    """A rollup: group columns, and for each aggregated column what is asked of it (sum, count, min, max, mean, std, var)."""

    name: str
    group_by: tuple[str, ...]
    aggregations: dict[str, tuple[str, ...]]

    def __post_init__(self):
        if not self.group_by:
            raise QueryError("group_by must not be empty")
        if not self.aggregations:
            raise QueryError("aggregations must not be empty")
        for c in (*self.group_by, *self.aggregations):
            TableColumn.of(c)
        for kinds in self.aggregations.values():
            for k in kinds:
                if k not in ASKED:
                    raise QueryError(f"Unknown aggregation type: {k}")
        object.__setattr__(self, "group_by", tuple(self.group_by))
        object.__setattr__(self, "components", {c: tuple(sorted({p for k in kinds for p in ASKED[k]})) for c, kinds in self.aggregations.items()})
        seen: dict[str, tuple] = {}
        for c, p in self.stored():
            if (other := seen.setdefault(physical(c, p), (c, p))) != (c, p):
                raise QueryError(f"{other} and {(c, p)} both encode to the physical column {physical(c, p)}")

    def stored(self) -> list[tuple[str, str | None]]:
        """(column, component) of each stored column; None for a group column."""
        return [(c, None) for c in self.group_by] + [(c, p) for c, parts in self.components.items() for p in parts]

    @property
    def tables(self) -> list[str]:
        return sorted({c.partition(".")[0] for c, _ in self.stored()})


def tagged(column: Column, name: str, component: str | None) -> Column:
    return column.alias(physical(name, component), metadata={METADATA: {"column": name, "component": component}})


def component(name: str, column: Column) -> Column:
    """A stored component of a column; squares are taken as doubles, so that integers don't overflow."""
    if name == "sumsq":
        return F.sum(column.cast("double") * column.cast("double"))
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[name](column)


def servable(a: Agg) -> bool:
    """Whether an aggregate can be put together from components: of a bare column, neither distinct nor filtered."""
    return a.fn in NEEDED and bare(a.of) is not None and not a.distinct and a.where is None


def rolled_up(a: Agg, part) -> Column:
    """The aggregate over stored components; `part(component)` is the stored column."""
    match a.fn:
        case "sum":
            return F.sum(part("sum"))
        case "count":
            return F.coalesce(F.sum(part("count")), F.lit(0))
        case "min":
            return F.min(part("min"))
        case "max":
            return F.max(part("max"))
    n, total = F.sum(part("count")), F.sum(part("sum")).cast("double")
    if a.fn in ("avg", "mean"):
        return F.try_divide(total, n)
    # sum of squared distances from the mean; rounding must not take it below zero
    spread = F.greatest(F.sum(part("sumsq")) - F.try_divide(total * total, n), F.lit(0.0))
    # of no value there is no spread, of one value no sample's
    less = 0 if a.fn.endswith("_pop") else 1
    variance = F.when(n > less, F.try_divide(spread, n - less))
    return F.sqrt(variance) if a.fn.startswith("std") else variance
