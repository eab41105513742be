"""Streams of operations: windows, pairs, alerts, duplicates and limits."""
