"""Repeated-measures analytics and corpus preparation as Spark DataFrame jobs."""
