"""shelfspark — retail profiling and recommendation jobs on Spark.

Every operator takes and returns Spark DataFrames; nothing is collected to the
driver except bounded scalars (a `max(timestamp)`, a table count) and MLlib
model metadata.
"""

__version__ = "0.1.0"
