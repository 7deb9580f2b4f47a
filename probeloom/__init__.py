"""probeloom: a Spark-native evidence engine for auditing knowledge edits."""

__version__ = "0.1.0"
