"""Importing this module registers every check."""

from millrace_checks import column_checks, event_checks, flow_checks  # noqa: F401
from millrace_checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
