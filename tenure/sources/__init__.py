"""Sources of the tenure engine."""
