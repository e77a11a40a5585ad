"""Functions of the pseudonymisation engine."""
