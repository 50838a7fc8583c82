"""The incremental operators on Structured Streaming."""
