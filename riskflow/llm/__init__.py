"""Operators that prepare training text: scoring, deduplication, extraction, mixing.

Nothing else in the library imports this subpackage. Each module is one
operator; ``queries`` applies them to the test tables. Python functions that
run in tasks import this package too: ship it with ``--py-files`` on a cluster.
"""
