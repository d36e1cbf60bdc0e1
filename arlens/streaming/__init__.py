"""arlens.streaming: incremental re-ingestion with Structured Streaming."""
