"""tessera: a PySpark-native engine for code-graph and document retrieval."""
