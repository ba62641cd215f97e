"""Relational operators over dictionaries, groups and raw lines."""
