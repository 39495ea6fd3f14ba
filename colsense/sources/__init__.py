"""Column classification on PySpark: readers and the long form."""
