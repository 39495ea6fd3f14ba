"""Column classification on PySpark: whole-table classification plans."""
