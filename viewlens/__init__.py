"""Viewing-activity analytics as Spark DataFrame jobs, in batch and on streams."""
