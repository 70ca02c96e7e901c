"""Contact-data quality and corpus preparation on PySpark."""
