"""pagewright: positioned document text to retrieval-ready chunks, as Spark DataFrame transforms."""
