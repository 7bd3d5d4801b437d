"""Operators for preparing training data: Spark jobs over documents, pages and vectors."""
