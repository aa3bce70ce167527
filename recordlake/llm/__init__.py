"""Training-corpus operators: each module holds one operator, catalog.py their queries."""
