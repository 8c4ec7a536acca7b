"""Training-data operators: ten corpus operators and their registered queries.

Nothing outside this package imports it; ``corpus_pipeline.py`` chains five of
the operators.
"""
