"""millrace: manufacturing telemetry analytics on Spark.

Bronze tables -> silver views -> gold results, telemetry operators, data-quality
checks, rule-based disturbance labelling, failure-risk model and Structured
Streaming versions of the live parts -- all as DataFrame / Spark SQL / Spark ML.
"""

from millrace.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
