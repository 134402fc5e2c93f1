"""Species-occurrence analytics by area, as PySpark DataFrame operations."""
