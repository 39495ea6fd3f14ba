"""Column classification on PySpark: text, vocabulary and scoring expressions."""
