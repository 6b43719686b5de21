"""Streaming forms: user-day counts with late data, and alert suppression with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def user_day_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(user_id, day, login_count, after_hours_login_count) of a stream of logon events with ``ts``; a day closes ``late`` after its end."""
    own = F.col("activity") == "Logon"
    hours = F.hour("ts")
    return (
        events.withWatermark("ts", late)
        .groupBy("user_id", F.window("ts", "1 day").alias("w"))
        .agg(F.count_if(own).alias("login_count"), F.count_if(own & ((hours < 8) | (hours >= 18))).alias("after_hours_login_count"))
        .select("user_id", F.to_date("w.start").alias("day"), "login_count", "after_hours_login_count")
    )


def suppress_alerts(alerts: DataFrame, days: int) -> DataFrame:
    """(user_id, day) of the alerts that stay: a user's next one comes at least ``days`` days after the last that stayed.

    The state is one day a user, whose id may be of any type. Days of one user must arrive in order across
    batches; within a batch they are sorted.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = sorted({d for f in frames for d in pd.to_datetime(f["day"]).dt.date})
        out = []
        for d in rows:
            if last is None or d.toordinal() - last >= days:
                out.append(d)
                last = d.toordinal()
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "day": out})

    return alerts.select("user_id", "day").groupBy("user_id").applyInPandasWithState(run, f"user_id {alerts.schema['user_id'].dataType.simpleString()}, day date", "last int", "append", GroupStateTimeout.NoTimeout)
