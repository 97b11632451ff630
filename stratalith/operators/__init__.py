"""Relational operators on logs, points and grids."""
