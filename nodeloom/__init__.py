"""Graph-node analytics as Spark DataFrame jobs."""
