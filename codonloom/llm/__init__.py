"""Operators for building language-model training data out of large document tables.

Each module holds one operator with a general interface; `entries` applies them to the
test tables. Nothing outside this subpackage imports it.
"""
