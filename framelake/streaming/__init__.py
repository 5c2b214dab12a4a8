"""The streaming source and sink of raster-sequence files."""
