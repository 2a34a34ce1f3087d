"""Queries over the driver's tables, and rendering of small results."""
