"""Whole programs composed of operators, and the command line."""
