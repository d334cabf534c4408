"""A Spark-first engine for retrieval, array and training-data workloads."""
