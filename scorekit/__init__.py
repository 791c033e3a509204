"""scorekit: Spark-native scoring, ranking and segmentation of rated entities.

Layout
------
- ``sources``   table bindings, CSV/Parquet IO, HTML page sources and card extraction
- ``functions`` Column-level helpers (rounding, exact averages, text cleaners, buckets)
- ``operators`` skew-safe DataFrame operators (group positions, ranks, NTILE, group stats)
- ``plans``     the 14 analyses, the cleaning job, data-quality reports, extraction jobs
- ``streaming`` incremental batch ingest with Structured Streaming
"""

__version__ = "0.1.0"
