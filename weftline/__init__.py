"""weftline: a Spark-native engine for linking, deduplicating and analysing
large collections of multilingual documents."""

__version__ = "0.1.0"
