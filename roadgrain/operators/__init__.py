"""Joins, aggregates, top-n and map-layer operators."""
