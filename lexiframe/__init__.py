"""lexiframe — labelled-text analytics as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column``).  Nothing is collected to the driver except results whose size is
bounded by construction (class names, per-class quotas, a handful of bucket
offsets).
"""

__version__ = "0.1.0"
