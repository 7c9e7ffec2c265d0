"""shoal: TPC-H order/shipment analytics expressed as Spark DataFrame and SQL jobs.

Sub-packages
------------
sources    readers and writers: pipe-delimited tables, Parquet, run logs, event logs
functions  column-expression helpers (keys, money, dates, text, hash draws)
operators  joins and join strategies, data-quality checks, refresh sets, windows
plans      the parameterised queries, query parameters, timed runs and log analytics
generate   table generation at any scale factor as `spark.range` jobs
streaming  incremental (Structured Streaming) form of the transfer-log analytics
"""

__version__ = "0.1.0"
