"""Operators for large training-text corpora, built on the DataFrame API.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
