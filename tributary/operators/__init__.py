"""Relational operators: cleaning, sessions, graphs, propagation, metrics, runs."""
