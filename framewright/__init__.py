"""framewright: a PySpark-native engine for ordered, multichannel and text data."""
