"""Event-stream and time-interval analytics as PySpark jobs."""
