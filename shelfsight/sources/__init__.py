"""Readers and writers: CSV, Parquet snapshots, partitioned copies, versioned tables."""
