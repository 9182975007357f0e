"""seasoncast — a PySpark-native engine for season demand forecasting.

Every operator is a function ``DataFrame -> DataFrame`` (or a small estimator
that fits a spec DataFrame and applies it).  Work is expressed with the
DataFrame / SQL API so Catalyst prunes columns, pushes filters into the
Parquet scan and plans partial + final aggregation; Python runs inside tasks
only where a numpy kernel is needed (blocked kNN, tree leaf statistics).
"""

from seasoncast.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
