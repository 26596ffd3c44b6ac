"""PySpark-native engine for retrieval-augmented question answering and training-data preparation."""
