"""storefront: shop analytics on Spark DataFrames, SQL and Structured Streaming.

Sub-packages:
  sources    canonical schemas, shop views over the driver tables, sinks
  functions  column-expression helpers and SQL table functions
  operators  dashboard metrics, rankings, joins, payment reports, quality, table changes
  streaming  payment-callback and transaction streams
  plans      the named query catalogue and its independent SQL oracle
"""

__all__ = ["sources", "functions", "operators", "streaming", "plans"]
