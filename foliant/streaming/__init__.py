"""The same ingest as a stream."""
