"""Operators for preparing language-model training corpora at cluster scale.

Self-contained: nothing outside this subpackage (and ``corpus_pipeline``) imports it.
"""
