"""The sequential detectors on Structured Streaming."""
