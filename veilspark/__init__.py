"""Consistent pseudonymisation of personal data on Spark."""
