"""Functions of the experiment engine."""
