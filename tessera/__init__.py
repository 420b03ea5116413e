"""Frame-semantic corpus work as Spark DataFrame jobs."""
