"""Set-oriented corpus indexing, retrieval and index maintenance on PySpark."""
