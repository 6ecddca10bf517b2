"""Relational, spatial and statistical operators over DataFrames keyed by ``codigo``."""
