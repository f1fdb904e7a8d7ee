"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it.  Each operator has a module of its
own with a general interface; ``queries`` holds the thin registered queries.
"""
