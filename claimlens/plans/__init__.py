"""Whole query plans over the test tables, and their registration."""

from claimlens.plans.oracles import ORACLE_SQL
from claimlens.plans.queries import QUERIES, arm_metrics

__all__ = ["ORACLE_SQL", "QUERIES", "arm_metrics"]
