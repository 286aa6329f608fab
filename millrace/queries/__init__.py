"""Named queries over the test tables, each with its SQL counterpart where one exists."""

from . import analytics, conversion, files, history, pools, serving  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
