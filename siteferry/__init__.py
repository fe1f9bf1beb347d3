"""siteferry: Spark jobs over site-migration data (dumps, surveys, probes, captures, inventories)."""
