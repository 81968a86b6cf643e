"""A PySpark-native engine for code-structure and relationship analytics."""
