"""The governance operators at work on the given business tables."""
