"""Frame-wise operators under Structured Streaming."""
