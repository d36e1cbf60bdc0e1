"""arlens: accounts-receivable analytics as composable PySpark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` function (use it with
``df.transform``) built from ``pyspark.sql.functions`` expressions, windows,
joins and aggregates, so Catalyst sees the whole plan.
"""

from arlens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
