"""Training-data operators: one module per operator, their registered queries and SQL.

Nothing outside this package imports it (apart from the guarded hook in
``__spark_entry__.py`` and ``corpus_pipeline.py``); it may be removed as a whole.
"""
