"""Point-in-time analytics as PySpark programs."""
