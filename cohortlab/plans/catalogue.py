"""Importing this module registers every query."""

from cohortlab.plans import q_audit, q_eval, q_models, q_network, q_prep, q_sources, q_stats, q_tables  # noqa: F401
from cohortlab.plans.registry import QUERIES

__all__ = ["QUERIES"]
