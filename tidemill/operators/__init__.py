"""Operators that Spark has no single method for, composed of DataFrame operations."""
