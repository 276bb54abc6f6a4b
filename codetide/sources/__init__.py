"""Readers and writers for the tables of `codetide.schemas`."""
