"""Relational operators: catalogue, distances, experiments, metrics, scaling."""
