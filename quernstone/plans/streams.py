"""The batch form of the streaming extension."""

from __future__ import annotations

from ..streaming.events import windowed_counts
from .registry import query
from .roles import table


@query("ext_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def ext_windows(spark, d):
    return windowed_counts(table(spark, d, "events"))
