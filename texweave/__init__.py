"""PySpark-native engine for preparing, profiling and scoring formula corpora."""

__version__ = "0.1.0"
