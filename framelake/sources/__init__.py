"""The batch source and sink of raster-sequence files."""
