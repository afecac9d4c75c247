"""pagewise: page monitoring and search-quality analytics as Spark DataFrame jobs.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing is collected to the driver; work is partitioned and shuffled
by Spark.  Sub-packages:

* ``functions`` - column expressions (URLs, dates, text, scores)
* ``sources``   - table loaders, watch-list / snapshot / hit readers, HTML -> DOM nodes
* ``operators`` - joins, aggregations and rankings over those tables
* ``plans``     - end-to-end pipelines (full scan, quick scan, monitoring run, search)
* ``streaming`` - continuous change detection on Structured Streaming
"""

__version__ = "0.1.0"
