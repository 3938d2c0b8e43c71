"""Spark-first evidence retrieval and corpus quality jobs."""
