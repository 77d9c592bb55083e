"""Plans of the tenure engine."""
