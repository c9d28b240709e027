"""Column functions of the alarm domain."""
