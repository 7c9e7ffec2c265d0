"""Table generation at any scale factor, one row per key of `spark.range`."""
