"""Readers, sinks and shared working storage."""
