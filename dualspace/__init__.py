"""dualspace — batch vector retrieval and retrieval evaluation on Spark DataFrames.

Tables in, tables out: chunk and query vectors are joined inside pools,
expanded through a low-dimensional structural space (decay traversal or
random walk with restart), scored, and rolled up into report tables.
"""

from dualspace.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
