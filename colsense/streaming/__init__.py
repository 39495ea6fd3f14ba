"""Column classification on PySpark: per-value scores over streams."""
