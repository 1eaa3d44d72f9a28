"""Registered queries: each module has ``QUERIES`` and ``SQL``."""

from codeweft.plans import graph, metrics, project, quality, reports, source, rollups, scale

PLANS = [metrics, rollups, graph, quality, reports, source, project, scale]
