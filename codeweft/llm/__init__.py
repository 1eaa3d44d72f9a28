"""Operators for preparing training data from code, commits and documents.

Optional: nothing outside this folder imports it, and the core works without it.
``queries()`` and ``oracle_sql()`` collect the modules of ``codeweft.llm.plans``.
"""
