"""Operators on layers: filters, aggregates and spatial joins."""
