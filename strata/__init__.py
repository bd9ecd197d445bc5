"""strata: Spark-first DataFrame operators for payment-history correction
reports, hierarchical size rollups, grouped log-normal intervals, text / XML /
JSON record tables and validation notices.

Every operator is a function ``DataFrame -> DataFrame`` built from
``pyspark.sql.functions``; nothing runs per row in Python.
"""

__version__ = "0.1.0"
