"""Queries of the citation operators: QUERIES and ORACLES, filled by the modules below."""

from citeloom.queries.registry import ORACLES, QUERIES

from citeloom.queries import aggregates, files, flows, joins, scalars, temporal, windows  # noqa: E402,F401  (register)
from citeloom.queries.flows import flagship  # noqa: E402,F401

__all__ = ["ORACLES", "QUERIES"]
