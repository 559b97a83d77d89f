"""scriptorium: document analytics as Spark DataFrame transformations.

Every operator is a function ``DataFrame -> DataFrame`` (usable with
``df.transform``) built from Spark SQL expressions; Python runs only inside
Arrow-batched functions where no built-in expression exists.
"""

from scriptorium.session import get_spark, checkpoint_dir, read_table

__all__ = ["get_spark", "checkpoint_dir", "read_table"]
