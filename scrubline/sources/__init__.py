"""Readers and writers for corpora and run metrics."""
