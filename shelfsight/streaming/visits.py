"""Visits of users: what one user does with pauses no longer than a gap. As session windows and as keyed state with timers.

An event within the gap of a user's visit joins it, or joins two visits to one, in whatever order the events arrive. A visit is given out once,
when the watermark (newest event time less the delay) has passed its last event by the gap, so no event that is still let in
can belong to it. Events behind the watermark are late: session windows drop a late event if no visit that is still open holds it;
the keyed state drops those whose own visit would already be closed. Open visits wait in the state for the next run.

Events without a user or a time belong to no visit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PURCHASE = "purchase"
VISIT = "user_id bigint, visit_start timestamp, visit_end timestamp, events bigint, purchases bigint, first_event string, last_event string"


def _known(events: DataFrame) -> DataFrame:
    return events.where("user_id is not null and ts is not null").select(F.col("user_id").cast("bigint").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Visits as session windows, batch or streaming; ``visit_end`` is the last event."""
    place = F.struct("ts", "event_id")
    return (
        _known(events)
        .withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", gap).alias("_session"))
        .agg(
            F.max("ts").alias("visit_end"),
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("event_type") == PURCHASE).alias("purchases"),
            F.min_by("event_type", place).alias("first_event"),
            F.max_by("event_type", place).alias("last_event"),
        )
        .select("user_id", F.col("_session.start").alias("visit_start"), "visit_end", "events", "purchases", "first_event", "last_event")
    )


def _merged(segments: list[list], gap: int) -> list[list]:
    """Segments [first (time, id, type), last, events, purchases] of one user, those within the gap joined."""
    out: list[list] = []
    for first, last, events, purchases in sorted(segments):
        if out and first[0] - out[-1][1][0] <= gap:
            held = out[-1]
            held[1] = max(held[1], last)
            held[2] += events
            held[3] += purchases
        else:
            out.append([first, last, events, purchases])
    return out


def _visits_of(gap_us: int):
    """Update of one user's open visits: a few numbers each, however many events they hold."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_visits = [[list(v[0]), list(v[1]), v[2], v[3]] for v in json.loads(state.get[0])] if state.exists else []
        watermark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for rows in batches:
                times = rows["ts"].astype("datetime64[us]").astype("int64")
                for at, event_id, kind in zip(times.tolist(), rows["event_id"].tolist(), rows["event_type"].tolist()):
                    if at + gap_us > watermark:
                        open_visits.append([[at, event_id, kind or ""], [at, event_id, kind or ""], 1, int(kind == PURCHASE)])
                # Joined by batch, so what is held follows the visits and not the events.
                open_visits = _merged(open_visits, gap_us)
        closed = [v for v in open_visits if v[1][0] + gap_us <= watermark]
        waiting = [v for v in open_visits if v[1][0] + gap_us > watermark]
        if waiting:
            state.update((json.dumps(waiting),))
            # The first of them that can be closed wakes the user again; timers count in milliseconds.
            state.setTimeoutTimestamp(-(-min(v[1][0] + gap_us for v in waiting) // 1000))
        elif state.exists:
            state.remove()
        if closed:
            stamp = lambda k: pd.to_datetime([v[k][0] for v in closed], unit="us")
            yield pd.DataFrame(
                {
                    "user_id": key[0], "visit_start": stamp(0), "visit_end": stamp(1), "events": [v[2] for v in closed],
                    "purchases": [v[3] for v in closed], "first_event": [v[0][2] or None for v in closed], "last_event": [v[1][2] or None for v in closed],
                }
            )

    return update


def visits(events: DataFrame, gap_seconds: int = 1800, delay: str = "1 hour") -> DataFrame:
    """Visits of a stream of events from keyed state with event-time timers."""
    known = _known(events).withWatermark("ts", delay)
    return known.groupBy("user_id").applyInPandasWithState(_visits_of(gap_seconds * 1_000_000), VISIT, "waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def run_visits(found: DataFrame, out: str, available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Append closed visits; a micro-batch that is run again replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/visits/batch={batch_id}")

    writer = found.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint")
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": interval})).start()
