"""Column classification on PySpark"""
