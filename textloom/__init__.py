"""A Spark-first engine for text retrieval, corpus statistics and link graphs."""
