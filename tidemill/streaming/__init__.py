"""Structured Streaming versions of event queries."""
