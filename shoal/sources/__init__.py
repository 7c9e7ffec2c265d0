"""Readers and writers: pipe-delimited tables, Parquet, fixture views, run and event logs."""
