"""A Spark-native engine: dependency maps of code bases, and training-data operators."""

__version__ = "1.0.0"
