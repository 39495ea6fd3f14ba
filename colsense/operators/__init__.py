"""Column classification on PySpark: per-value and per-column operators."""
