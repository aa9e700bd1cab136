"""millrace: a PySpark-native analytics engine.

Plans are declared with the DataFrame and SQL API and left to Catalyst; the
packages below only add what Spark has no built-in for.
"""
