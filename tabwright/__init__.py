"""Tabular analytics and model ranking as Spark jobs."""
