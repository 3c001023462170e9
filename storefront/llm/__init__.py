"""Training-data operators: dedup, classifiers, scoring, formatting, encoding.

One module per operator; ``catalogue`` registers the ``opN_*`` queries.
Nothing outside this package imports it except ``__spark_entry__`` and
``corpus_pipeline``.
"""
