"""Training-data operators (thirteen of them) on Spark DataFrames.

Nothing outside this subpackage imports it; ``tagweave.llm.queries`` binds each
operator to the driver's tables.
"""
