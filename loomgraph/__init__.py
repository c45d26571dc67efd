"""Code-graph analytics as Spark jobs."""
