"""Image catalogues and human-similarity studies as Spark tables."""
