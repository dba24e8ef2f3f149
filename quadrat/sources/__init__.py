"""Sources of the experiment engine."""
