"""Sheet, scan and sequence analytics as PySpark jobs."""
