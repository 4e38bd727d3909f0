"""Registered queries, by family."""

from . import catalog, dose, geometry, phase_space, plan, planning
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalog", "dose", "geometry", "phase_space", "plan", "planning"]
