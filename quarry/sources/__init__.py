"""Tables, pre-aggregations and their store."""
