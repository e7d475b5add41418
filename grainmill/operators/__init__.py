"""Relational and grouped-map operators of the analysis."""
