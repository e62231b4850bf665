"""Operators of a training-data pipeline: identification, deduplication,
decontamination, filtering and packing of document corpora.

Nothing else in the library imports this subpackage.
"""
