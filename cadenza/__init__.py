"""A PySpark-native engine for cleaning and analysing large collections of media metadata and text."""
