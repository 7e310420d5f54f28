"""corpusmill: a Spark-native engine to build, search, audit and prepare text corpora."""

__version__ = "0.1.0"
