"""Operators for large training-data pipelines.

Every module holds one operator with a general interface; ``queries`` turns
them into the registered ``opN_*`` queries. Nothing outside this subpackage
imports it.
"""
