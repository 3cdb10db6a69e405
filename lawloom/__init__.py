"""lawloom: a Spark-native engine for hierarchical legal text, its graph and its retrieval."""

__version__ = "0.1.0"
