"""Structured Streaming jobs over telemetry."""
