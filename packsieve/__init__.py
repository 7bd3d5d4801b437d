"""Predicate evaluation and audit analytics as Spark DataFrame jobs."""
