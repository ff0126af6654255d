"""Join keys for look-ups from a large table, in which some keys may hold most of the rows.

Spark splits a skewed partition at run time only where both inputs of the join are plain shuffles. A
looked-up table that was aggregated by its key is already laid out by that key and gets no shuffle of
its own, so no split either. Joining on a key made after the aggregation brings the shuffle, of the
already reduced rows, and with it the split. Rows without a key match nothing and are spread by their
own id instead of meeting under null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup_key(*key: Column) -> Column:
    """The key of the looked-up side; null if any part is missing or empty."""
    parts = [F.nullif(c.cast("string"), F.lit("")) for c in key]
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit("\u0000"), part)
    return F.concat(F.lit("="), joined)


def spread_key(row_id: Column, *key: Column) -> Column:
    """The key of the large side of a left join; a row without a key gets one that nothing has."""
    return F.coalesce(lookup_key(*key), F.concat(F.lit("\u0000"), row_id.cast("string")))
