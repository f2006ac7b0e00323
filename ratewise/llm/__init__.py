"""Operators for large training corpora, each a Spark job over whole tables.

Nothing outside this subpackage imports it; ``ratewise.llm.queries`` holds the
registered queries and their oracle SQL.
"""
