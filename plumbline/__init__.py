"""Plumbline: Spark jobs that turn observational tables into auditable, typed results."""
