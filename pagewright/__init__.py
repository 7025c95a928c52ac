"""A Spark-first engine for document-text quality analytics."""
