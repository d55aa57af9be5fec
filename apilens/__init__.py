"""A PySpark-native engine for the API surface of stored web documents."""
