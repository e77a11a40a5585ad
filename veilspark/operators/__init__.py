"""Operators of the pseudonymisation engine."""
