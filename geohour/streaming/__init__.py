"""Structured Streaming path for polled sensors."""
