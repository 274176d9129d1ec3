"""Incremental versions of the batch steps, for a folder that gets new snapshots."""
