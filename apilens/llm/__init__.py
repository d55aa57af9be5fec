"""Training-data operators on Spark: one module per operator.

Nothing outside this subpackage imports it; ``registry`` gathers the queries.
"""
