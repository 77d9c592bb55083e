"""Functions of the tenure engine."""
