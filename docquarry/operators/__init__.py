"""Operators: DataFrame in, DataFrame out, keyed by query_id where there are queries."""
