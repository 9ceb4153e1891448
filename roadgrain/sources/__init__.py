"""Readers, writers and the crash-shaped views used for testing."""
