"""Plans of the experiment engine."""
