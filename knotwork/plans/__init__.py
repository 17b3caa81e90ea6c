"""Lattice, discovery and experiments."""
