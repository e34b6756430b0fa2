"""Tails of tables: consecutive half-open windows of event time, each row at most once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: rows of a source that one step of a tail shows.
PAGE = 500


def next_window(cursor: datetime, now: datetime) -> tuple[datetime, datetime] | None:
    """[cursor, now), or nothing while the clock stands; windows in turn leave no gap and do not overlap."""
    return (cursor, now) if now > cursor else None


def tail_step(sources: dict[str, tuple[DataFrame, str | None]], cursor: datetime, now: datetime, n: int = PAGE) -> tuple[dict[str, DataFrame], datetime]:
    """(rows of the window by source, next cursor). Sources without a time column are left out, as they would repeat.

    A row older than the cursor when it arrives is not shown again; the rows shown are the newest `n` of the window.
    """
    window = next_window(cursor, now)
    if window is None:
        return {}, cursor
    low, high = (F.lit(m).cast("timestamp_ntz") for m in window)
    found = {}
    for name, (df, time_col) in sources.items():
        if time_col is not None:
            at = F.col(time_col)
            found[name] = df.where((at >= low) & (at < high)).orderBy(F.desc(time_col)).limit(n)
    return found, window[1]
