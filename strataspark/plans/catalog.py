"""Every query by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import correlations, geometry, inverse, joins, kernels, lookups, maps, models, noise, parameters, paths, posterior, selection, sphere, stacking, surface, travel, windows  # noqa: F401
from .registry import QUERIES, SQL
from .stacking import pair_stack as flagship

__all__ = ["QUERIES", "SQL", "flagship"]
