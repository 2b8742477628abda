"""Incremental reading of the result log."""
