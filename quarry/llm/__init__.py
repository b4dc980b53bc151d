"""Training-data operators: ten building blocks of a large-scale text pipeline.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds `registry`'s
queries only where the subpackage is present.
"""
