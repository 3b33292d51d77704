"""Snapshot analysis, model order reduction and mesh sampling as Spark DataFrame jobs."""
