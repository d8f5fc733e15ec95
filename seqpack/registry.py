"""Every query of the engine by name, and the SQL it is held against."""

from __future__ import annotations

from seqpack.plans import codes, sequences, stores, tensors, verdicts  # noqa: F401  entering their queries
from seqpack.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
