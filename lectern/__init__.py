"""lectern: a Spark-first engine for document retrieval and corpus processing."""
