"""Sources of the pseudonymisation engine."""
