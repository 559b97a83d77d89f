"""Registered queries over the supplied tables and their SQL oracles."""

from scriptorium.plans.registry import QUERIES, ORACLES  # noqa: F401
from scriptorium.plans import vectors_q, lines_q, keywords_q, graph_q, jobs_q, sources_q, fields_q, quality_q  # noqa: F401  (registers)
