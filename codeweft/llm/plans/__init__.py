"""Registered queries of the llm sub-package: each module has ``QUERIES`` and ``SQL``."""

from codeweft.llm.plans import code, documents, files, people

PLANS = [people, code, documents, files]
