"""Readers that turn landed files into validated tables."""
