"""Scalar building blocks: text of payloads, content predicates, checksums, validation."""
