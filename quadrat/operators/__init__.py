"""Operators of the experiment engine."""
