"""Physical building blocks (chunks, skew, checks of size) and query plans."""
