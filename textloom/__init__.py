"""textloom: a PySpark-native engine for curating and analysing text corpora."""

__version__ = "0.1.0"
