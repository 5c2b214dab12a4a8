"""A Spark-native engine for uncompressed raster sequences: files as tables, operators as DataFrame functions."""

__version__ = "0.1.0"
