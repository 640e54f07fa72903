"""Registered queries: every operator on the given tables, with the SQL it must equal."""

from structpeak.queries import baselines, evaluation, labelling, mixed, modelling, reporting, series, sources, testing  # noqa: F401
from structpeak.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
