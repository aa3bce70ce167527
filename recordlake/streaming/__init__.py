"""Streaming of the court-record engine."""
