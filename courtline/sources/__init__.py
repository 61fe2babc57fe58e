"""Landing of raw feeds and writing of published tables."""
