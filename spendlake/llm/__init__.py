"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. Each module is one operator with its
own general interface; ``spendlake.llm.queries`` registers the thin contract queries.
"""
