"""Document catalog and relation graphs as Spark jobs."""
