"""Operators for preparing language-model training data.

Nothing outside this folder, its tests and corpus_pipeline.py imports it.
"""
