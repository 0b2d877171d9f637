"""Streaming forms of the profile and telemetry operators."""
