"""Declarative feature plans and the query catalogue."""
