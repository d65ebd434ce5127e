"""Structured Streaming jobs over landed frames and detections."""
