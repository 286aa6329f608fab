"""millrace: batch model requests on Spark, from source rows to run metrics."""

from .session import configure, local_session, scratch_dir

__all__ = ["configure", "local_session", "scratch_dir"]
