"""Timeline analytics for catalogs of tracks, as plain Spark DataFrame functions."""
