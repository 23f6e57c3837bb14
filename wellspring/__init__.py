"""Trace analytics on Spark: quality filters, spatial smoothing, onset times, metrics."""
