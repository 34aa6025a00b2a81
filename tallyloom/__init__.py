"""Spark-native analytics over transformation-project metadata.

Every operator takes DataFrames and returns DataFrames; nothing here needs more
than a ``SparkSession``.
"""
