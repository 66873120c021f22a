"""Operators on stop visits and route requests."""
