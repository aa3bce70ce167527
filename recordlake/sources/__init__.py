"""Sources of the court-record engine."""
