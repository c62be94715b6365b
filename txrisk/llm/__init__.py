"""Operators for preparing large training corpora.

Each module holds one operator over a table of documents; ``queries`` binds
them to the test tables.  Nothing outside this folder imports it.
"""
