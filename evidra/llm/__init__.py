"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; ``corpus_pipeline.py`` at the
repository top chains five of the operators.
"""
