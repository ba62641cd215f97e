"""Operators for the preparation of training text. Nothing else in echolex imports this package."""
