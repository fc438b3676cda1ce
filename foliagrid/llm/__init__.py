"""Operators for preparing large text corpora.

Nothing outside this folder imports it; the rest of the library works when it is removed.
"""
