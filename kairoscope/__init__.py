"""Point-in-time analytics on PySpark.

``functions`` holds column expressions, ``operators`` functions from DataFrames
to DataFrames, ``sources`` readers and writers, ``streaming`` the incremental
ingest, and ``plans`` the queries over the driver's tables with their SQL.
"""
