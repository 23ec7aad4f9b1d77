"""Whole queries and table jobs composed from the operators."""
