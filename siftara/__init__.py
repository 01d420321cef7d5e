"""siftara: a Spark-native engine for building, screening and judging evaluation corpora."""

__version__ = "0.1.0"
