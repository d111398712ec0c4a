"""Spatial impact analytics on Spark: versioned polygon layers, grid-partitioned spatial joins, assessments, data-quality gates."""
