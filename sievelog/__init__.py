"""Analysis of partitioned record logs with JSON values on PySpark."""
