"""Operators for preparing language-model training data, each one a Spark job.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
