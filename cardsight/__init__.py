"""cardsight: Spark-native analytics for transaction tables with a rare positive class.

Every operator takes and returns a ``pyspark.sql.DataFrame`` (or a Spark ML stage),
keeps its work inside Catalyst/Tungsten expressions and never collects rows.
"""

__version__ = "0.1.0"
