"""DataFrame operators on headers, planes and auxiliary data."""
