"""Session-log analytics as Spark jobs."""
