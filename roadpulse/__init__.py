"""roadpulse: Spark-native analytics for timestamped, segment-matched speed observations.

Every operator is a plain function ``fn(df, ..., params) -> DataFrame`` that
declares a logical plan.  Exact quantiles, scaling statistics and K-Means run
their bounded sub-jobs eagerly (like a model fit); nothing reaches the driver
unless its size is bounded by a parameter (k centroids, one row of scaling
statistics, one probe value).

Subpackages
-----------
sources    readers, fixture adapters over the supplied tables, table writers
functions  column expressions (parsing, day type, floors, rounding)
operators  aggregations, rankings, quality checks, quantiles, clustering
plans      end-to-end stage compositions (feasibility, analysis, clustering, insights)
"""

from roadpulse.params import Thresholds, PeakHours, ClusterParams  # noqa: F401

__all__ = ["Thresholds", "PeakHours", "ClusterParams"]
