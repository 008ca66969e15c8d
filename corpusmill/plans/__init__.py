"""Queries over the driver's tables, by area."""
