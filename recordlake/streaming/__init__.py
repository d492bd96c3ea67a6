"""Changelog replay as Structured Streaming."""
