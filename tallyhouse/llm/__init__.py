"""Operators for building language-model training corpora.

Everything here is optional: nothing else in the library imports this subpackage.
"""
