"""Genome-scaffolding analytics as Spark DataFrame operations."""
