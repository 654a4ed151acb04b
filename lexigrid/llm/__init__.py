"""Operators for large training-data pipelines.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
