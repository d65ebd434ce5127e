"""Importing this module registers every query."""

from fringeframe.plans import q_bands, q_calibrate, q_catalog, q_detect, q_evaluate, q_sources, q_spatial, q_spectral  # noqa: F401
from fringeframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
