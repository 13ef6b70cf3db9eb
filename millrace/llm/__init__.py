"""Operators of a training-data pipeline (dedup, search, scoring, tokens, PII).

Each module holds one operator with a general interface; ``queries`` derives
the registered ``opN_<name>`` digests from them. Nothing outside this
subpackage imports it.
"""
