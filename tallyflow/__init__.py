"""Ad, review and event analytics as PySpark DataFrame jobs."""
