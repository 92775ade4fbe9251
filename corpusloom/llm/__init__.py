"""Training-data operators: tokenisation, deduplication, filtering, archives.

Nothing outside this folder imports it, apart from the top-level
``corpus_pipeline.py`` and the guarded registration in ``__spark_entry__.py``.
"""
