"""Registered queries: each a Spark query over the given tables, most with the same question as DuckDB SQL.

Every module fills ``QUERIES`` (name to function of session and table directory) and ``ORACLES``
(name to SQL text).
"""
