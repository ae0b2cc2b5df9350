"""A PySpark-native engine for text curation, log reporting, evaluation scoring and training-data preparation."""
