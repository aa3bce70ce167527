"""Operators of the court-record engine."""
