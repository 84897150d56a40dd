"""A PySpark-native engine for observation catalogs, image-sequence pipelines and training-data operators."""
