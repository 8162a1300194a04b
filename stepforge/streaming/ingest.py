"""Event streams to step-function segments: beyond what a batch needs, for functions that grow.

Each event's value holds until the entity's next event. State is one (time, value) for each entity; late events, behind the
entity's last one, are left out.
"""

import pandas as pd

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def segments_from_stream(events: DataFrame, entity: str = "user_id", ts: str = "ts", value: str = "value", watermark: str = "1 day") -> DataFrame:
    """Streaming (entity, l, r, v) with times in microseconds, appended as the next event of an entity comes."""

    def step(key, frames, state: GroupState):
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        last = state.get if state.exists else None
        out = []
        for t, v in zip(rows["t"].tolist(), rows["v"].tolist(), strict=True):
            if last is not None and t <= last[0]:
                continue
            if last is not None:
                out.append((key[0], last[0], t, last[1]))
            last = (t, v)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["entity", "l", "r", "v"])

    rows = events.withWatermark(ts, watermark).select(F.col(entity).alias("entity"), F.unix_micros(F.col(ts)).alias("t"), F.col(value).cast("double").alias("v"))
    kind = events.schema[entity].dataType.simpleString()
    return rows.groupBy("entity").applyInPandasWithState(step, f"entity {kind}, l long, r long, v double", "t long, v double", "append", GroupStateTimeout.NoTimeout)


def windowed_integral(events: DataFrame, ts: str = "ts", value: str = "value", window: str = "1 hour", watermark: str = "1 day", key: str = "event_type") -> DataFrame:
    """Count, sum and largest value of each tumbling window: late rows within the watermark still count."""
    return events.withWatermark(ts, watermark).groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("top"))
