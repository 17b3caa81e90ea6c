"""Dependency discovery for Spark DataFrames: functional and multivalued dependencies."""

from knotwork.operators.sample import Sampling
from knotwork.plans.discover import Options, Result, discover
from knotwork.plans.lattice import Pruning

__all__ = ["Options", "Pruning", "Result", "Sampling", "discover"]
