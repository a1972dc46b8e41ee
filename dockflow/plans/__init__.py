"""Assembled jobs: the batch build, the live batch and the registered queries."""
