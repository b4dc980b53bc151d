class QueryError(ValueError):
    """A query, measure or definition that can't be answered, with the reason."""
