"""marlspike: a Spark-native document retrieval engine."""

__version__ = "0.1.0"
