"""Event-graph analytics on Spark: hits, candidate edges, tracks and their metrics.

Every table carries ``event_id`` and every operator keys on it, so one job works
on all events at once.
"""
