"""Plans of the court-record engine."""
