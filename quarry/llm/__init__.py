"""Operators for preparing training corpora.

Each module holds one operator with a general interface; ``queries`` derives the
digest columns of the registered queries from their outputs.  Nothing outside this
subpackage imports it.
"""
