"""Column functions: constants, text fields and samples."""
