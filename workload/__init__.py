"""Queries over the test tables, one or more per operator."""

from workload import enforcement, lifecycle, metadata, records
from workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "enforcement", "lifecycle", "metadata", "records"]
