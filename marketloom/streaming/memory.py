"""Memories closed as a stream: state a memory, with event-time timers at the first look and the last."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.memory import FIRST_LOOK, GIVEN_UP

DAY = 86_400_000
CLOSED = "list_type string, ticker string, date date, status string, closed_on date, return_5d double"


def closed(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The memories of a stream that are closed, with the day on which a daily look would have closed them.

    ``events`` (list_type, ticker, date, day, return_5d): a memory is an event on its own date, its outcome one on the
    day when its bars were enough (``day`` in days since 1970; ``return_5d`` then). A memory is verified on the first
    day from the first look on that has an outcome, and given up on the day after the last look. Events come in any
    batches, and late by less than ``delay``; those of one memory are one state of three values, let go when no more can come.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        list_type, ticker, date = key
        born = (date - dt.date(1970, 1, 1)).days
        ready, value, done = state.get if state.exists else (None, None, False)
        for rows in batches:
            for day, r in zip(rows["day"], rows["return_5d"], strict=True):
                if day > born and (ready is None or day < ready):
                    ready, value = int(day), None if pd.isna(r) else float(r)
        first, last = born + FIRST_LOOK, born + GIVEN_UP + 1
        now = state.getCurrentWatermarkMs()
        if ready is not None and ready <= last:
            due, verdict = max(first, ready), "verified"
        else:
            due, verdict, value = last, "insufficient_data", None
        if done:
            pass  # an event after the memory was closed
        elif state.hasTimedOut or now > due * DAY or (ready is not None and due == ready):
            yield pd.DataFrame([(list_type, ticker, date, verdict, dt.date(1970, 1, 1) + dt.timedelta(days=due), value)], columns=["list_type", "ticker", "date", "status", "closed_on", "return_5d"])
            done = True
        if done:
            if state.hasTimedOut or now > (last + 1) * DAY:
                state.remove()
                return
            due = last + 1  # kept until no event of it can come
        state.update((ready, value, done))
        state.setTimeoutTimestamp(max(due * DAY, now + 1))

    stamped = events.withColumn("ts", F.timestamp_seconds(F.col("day") * 86_400)).withWatermark("ts", delay)
    return stamped.groupBy("list_type", "ticker", "date").applyInPandasWithState(step, CLOSED, "ready long, value double, done boolean", "append", GroupStateTimeout.EventTimeTimeout)
