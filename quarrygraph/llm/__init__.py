"""Training-data operators: one module for each, queries in ``queries.py``.

Nothing outside this subpackage (and ``corpus_pipeline.py``, which counts as part of it) imports it.
"""
