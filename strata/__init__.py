"""strata: layered commerce and operations analytics on Spark.

Raw files -> clean tables -> analytics marts -> report queries, plus
operational tables (cost lines, audit events, spans, metrics, storage
objects, task runs).  Every operator is a function from DataFrames to a
DataFrame built from stock Spark SQL expressions; nothing here triggers an
action except the pipeline runner and the sinks.
"""

from strata.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
