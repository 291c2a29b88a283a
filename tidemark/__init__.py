"""Snapshot-history analytics on PySpark: nested snapshots in, per-key time-series features out."""
