"""Structured Streaming: events in, scores and indicators out. State is bounded by watermarks."""
