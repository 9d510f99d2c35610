"""wearline: fleet condition-monitoring analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    readers for the driver tables, the fixture views and the
           trajectory / request / artifact formats
functions  column expressions (no actions, no shuffles)
operators  DataFrame -> DataFrame building blocks (validation, windows,
           ordered prefix sums, statistics, metrics, splits, detectors, models)
plans      the registered queries and their DuckDB oracle SQL
streaming  Structured Streaming versions of the scoring and alert jobs
"""

from .session import get_session, checkpoint_dir  # noqa: F401
