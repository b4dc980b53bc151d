"""Quarry: a Spark-native semantic layer for read-heavy analytics."""

from quarry.errors import QueryError
from quarry.functions.columns import TableColumn, allow, exclude
from quarry.plans.contexts import AggQuery, ColumnValuesMode, ColumnValuesQuery, ViewQuery
from quarry.plans.joins import Join, JoinGraph
from quarry.plans.model import DataModel
from quarry.sources.preagg import PreAggregation

__all__ = [
    "AggQuery", "ColumnValuesMode", "ColumnValuesQuery", "DataModel", "Join", "JoinGraph", "PreAggregation", "QueryError", "TableColumn", "ViewQuery", "allow", "exclude",
]
