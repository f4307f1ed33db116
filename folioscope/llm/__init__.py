"""Training-data pipeline operators: one module for each of the ten operators.

``queries.py`` registers the thin ``opN_*`` queries. Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
