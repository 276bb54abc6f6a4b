"""Code-change analytics on Spark: corpus indexing, symbol extraction, similarity
retrieval, impact, risk scoring and review reports over tables of many repositories
and many change requests."""
