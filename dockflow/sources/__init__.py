"""Scans: trip CSV, manifests, station metadata, feed snapshots and event records."""
