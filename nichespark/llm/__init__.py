"""Corpus operators for training data: deduplication, filtering, scoring, packing and placement.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
