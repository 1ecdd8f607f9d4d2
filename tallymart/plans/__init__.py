"""Compositions of operators: the batch pipeline, guarded SQL and the query registry."""
