"""PySpark-native analytics engine for multimodal place data."""
