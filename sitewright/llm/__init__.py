"""Operators of training-data pipelines: mixing, deduplication, decontamination, token counts, search, classifiers, archives.

Nothing else in the library imports this package. `queries.py` registers one query for each operator.
"""
