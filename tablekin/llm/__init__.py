"""Operators of a training-data pipeline over documents, benchmark, labels and conversations.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
