"""Registered queries of the engine's own operators."""

from siltworks.queries import abilities, blocks, cleaning, facts, folded, governance, graphs, lines, pages, payloads, records, retrieval, scoring, sections, sheets, structured, tables, titles, windowed  # noqa: F401
from siltworks.registry import ORACLES, QUERIES  # noqa: F401
