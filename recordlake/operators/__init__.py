"""Changelog to state: pure functions from DataFrame to DataFrame."""
