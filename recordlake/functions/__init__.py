"""Functions of the court-record engine."""
