"""Named end-to-end pipelines and the query catalogue."""
