"""Queries over the supplied tables, each beside its SQL."""
