"""Operators over cubes: one row for each time and grid point."""
