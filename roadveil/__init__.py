"""Exposure-aware street-network analytics as Spark DataFrame jobs."""
