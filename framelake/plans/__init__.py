"""Sizes, offsets and partitions of a file."""
