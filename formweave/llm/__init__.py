"""Operators that prepare text corpora for model training.

Nothing else in the library imports this subpackage; deleting it leaves the
template-extraction engine whole.
"""
