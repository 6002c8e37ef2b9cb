"""quarry — a Spark-native toolkit for checking, preparing, splitting,
comparing and scoring tabular data.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a
``pyspark.ml`` Estimator/Model pair) that runs on the executors.  The
driver only ever holds fitted statistics (one-row frames, small
category lists, p×p matrices), never table rows.
"""

__version__ = "0.1.0"
