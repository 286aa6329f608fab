"""Error text to coarse error category (P25)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in the order they are tried, with the texts that select them.
ERROR_MARKERS = {
    "timeout": ["timeout", "timed out"],
    "rate_limit": ["429", "rate limit"],
    "server": ["500", "502", "503", "504", "server"],
    "validation": ["valueerror", "validation", "invalid", "unsupported url"],
}
ERROR_CATEGORIES = (*ERROR_MARKERS, "other")


def error_category(error: Column) -> Column:
    """First category with a marker anywhere in the text, ignoring case."""
    text = F.lower(F.coalesce(error, F.lit("")))
    expr = None
    for name, markers in ERROR_MARKERS.items():
        hit = text.rlike("|".join(markers))
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise("other")


def failed(error: Column) -> Column:
    """A result failed when its error text is not empty (F8)."""
    return F.coalesce(error, F.lit("")) != ""
