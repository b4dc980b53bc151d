"""A query for each operation of the semantic layer over the standard tables, with the SQL that it must agree with."""
