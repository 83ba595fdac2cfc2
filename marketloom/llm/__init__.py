"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and ``corpus_pipeline.py`` at the repository top chains five of the
operators.
"""
