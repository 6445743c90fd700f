"""A PySpark-native engine for versioned key-value data and training-corpus preparation."""
