"""Operators for preparing training text: filters, de-duplication, sharding, tokens, packed output.

Nothing outside this folder imports it; ``registry`` lists its queries and their SQL.
"""
