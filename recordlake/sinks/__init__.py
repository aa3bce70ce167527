"""Sinks of the court-record engine."""
