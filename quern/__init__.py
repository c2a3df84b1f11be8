"""quern: a PySpark-native engine for security analytics and training-data work."""
