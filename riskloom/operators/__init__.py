"""Relational operators on the logs."""
