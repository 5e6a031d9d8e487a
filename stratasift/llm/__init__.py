"""Operators of a training-data pipeline: filters, near-duplicates, tokens, model scores.

Nothing outside this folder imports it, except the guarded import of ``__spark_entry__.py``
and ``corpus_pipeline.py``. The operators' task code is imported on the executors; the package
sends itself there.
"""
