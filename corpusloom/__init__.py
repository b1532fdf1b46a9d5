"""Document-corpus analytics on Spark: retrieval, scoring, coverage and reports."""
