"""Operators for preparing large text corpora, each a Spark job over a whole table.

Nothing outside this subpackage imports it.
"""
