"""Operators for preparing training text: each module holds one operator.

Nothing outside this folder imports it. The queries and their SQL are in ``queries``.
"""
