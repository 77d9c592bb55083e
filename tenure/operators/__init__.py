"""Operators of the tenure engine."""
