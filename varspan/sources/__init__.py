"""Readers and sinks of intervals, alignments and calls."""
