"""Whole analyses, registered queries and lineage cuts."""
