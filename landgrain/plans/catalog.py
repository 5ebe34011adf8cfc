"""Every registered query by name, with its SQL."""

from landgrain.plans import estimates, ground, levels, reports  # noqa: F401
from landgrain.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
