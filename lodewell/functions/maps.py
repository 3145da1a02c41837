"""Maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(left: Column, right: Column) -> Column:
    """Both maps' entries; right wins on equal keys, whatever the session's policy for duplicate keys is. Null if either is."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)
