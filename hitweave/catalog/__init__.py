"""Registered queries and their oracle SQL."""

from . import chains, graph_tables, neighbour_graphs, reading, tracks, truth_tables  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
