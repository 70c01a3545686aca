"""shelfwise — retail analytics as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; Catalyst
plans the work, and nothing is pulled to the driver except bounded results
(a handful of quantile cut points, the per-bin counts of a selection round).

Sub-packages:

* ``sources``    — schemas, Parquet loaders, the enriched star join, sinks and
                   the adapter from TPC-H-style tables to the retail model.
* ``functions``  — Column-level helpers: calendar, money, statistics, ranking,
                   and the Holt-Winters kernel used inside grouped pandas UDFs.
* ``operators``  — the analytics: descriptive, RFM, cohort, forecast,
                   prescriptive, data quality, invoice ids.
* ``plans``      — the query catalogue (name → DataFrame builder), its DuckDB
                   oracle text, and plan-shape checks.
* ``streaming``  — the transaction loader as a file stream.
"""

from shelfwise.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
