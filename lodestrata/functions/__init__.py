"""Column functions and incremental functions."""
