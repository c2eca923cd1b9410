"""mutascope: Spark-native protein-property analytics.

Every public operator takes and returns ``pyspark.sql.DataFrame`` objects and
takes column names as parameters. Heavy lifting is left to Catalyst: the
operators build declarative plans from built-in column expressions; Arrow
``mapInPandas`` is used only for pluggable encoders and the dense network head.
"""

from mutascope.session import get_session, checkpoint_dir, materialize

__all__ = ["get_session", "checkpoint_dir", "materialize"]
