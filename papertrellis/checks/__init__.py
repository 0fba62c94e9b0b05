"""Registered queries over the given tables, each with its oracle SQL where SQL can say it."""

from papertrellis.checks import applications, catalog, curation, factors, graph, pages, retrieval  # noqa: F401
from papertrellis.checks.registry import ORACLES, QUERIES  # noqa: F401
