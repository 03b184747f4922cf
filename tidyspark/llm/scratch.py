"""Shared tables that cut lineage, below ``spark.checkpoint.dir`` as all written stages of the engine."""

from __future__ import annotations

from ..operators.stage import forget as drop
from ..operators.stage import written as table

__all__ = ["drop", "table"]
