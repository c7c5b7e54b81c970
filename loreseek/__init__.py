"""loreseek: a PySpark-native engine for searching content-addressed document histories."""
