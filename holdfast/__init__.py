"""Retention analytics for subscriber tables, as Spark DataFrame jobs."""
