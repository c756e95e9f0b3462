"""Registered queries and the SQL that states their results."""

from __future__ import annotations

from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
