"""Streaming of the pseudonymisation engine."""
