"""Readers, writers, keyed tables and the result cache."""
