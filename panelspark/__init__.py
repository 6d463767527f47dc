"""Spark operators for past-only spatio-temporal panels, event sessions and rare-event evaluation."""
