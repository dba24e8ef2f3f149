"""Streams into the panel: an addition beside the batch engine."""
