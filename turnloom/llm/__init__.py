"""Operators for preparing training text; nothing outside this package and corpus_pipeline.py uses them."""
