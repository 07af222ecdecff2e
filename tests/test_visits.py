"""Visits of a stream beside those of stored events: order of arrival, joined visits, late events, timers."""

import os
from datetime import datetime, timedelta

import pytest
from conftest import rows

from shelfsight.streaming import orders as live
from shelfsight.streaming import visits

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string"
START = datetime(2024, 1, 1)


def event(key, minutes, user=1, kind="view"):
    return (key, None if minutes is None else START + timedelta(minutes=minutes), user, kind)


def land(spark, folder, name, data):
    target = f"{folder}/_{name}"
    spark.createDataFrame(data, EVENTS).coalesce(1).write.parquet(target)
    part = next(p for p in os.listdir(target) if p.startswith("part-"))
    os.rename(f"{target}/{part}", f"{folder}/{name}.parquet")


def plain(events, gap=30):
    out = []
    for user in {e[2] for e in events if e[2] is not None and e[1] is not None}:
        own, held = sorted((e[1], e[0], e[3]) for e in events if e[2] == user and e[1] is not None), []
        for at in own:
            if held and at[0] - held[-1][-1][0] <= timedelta(minutes=gap):
                held[-1].append(at)
            else:
                held.append([at])
        out += [(user, v[0][0], v[-1][0], len(v), sum(e[2] == "purchase" for e in v), v[0][2], v[-1][2]) for v in held]
    return sorted(out, key=str)


FINDERS = {"windows": lambda stream: visits.sessions(stream, "30 minutes", "1 hour"), "state": lambda stream: visits.visits(stream, 1800, "1 hour")}


def run(spark, inbox, out, finder):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", "1").parquet(f"{inbox}/*.parquet")
    visits.run_visits(FINDERS[finder](stream), out).awaitTermination()
    return rows(live.read_sink(spark, out, "visits", visits.VISIT))


FIRST = [event(1, 0), event(2, 29), event(3, 60), event(4, 75, kind="purchase"), event(5, 10, user=2), event(6, 41, user=2), event(7, None), event(8, 5, user=None)]
#: Out of order, but within the hour: 9 joins the visits around it.
SECOND = [event(9, 11, user=2, kind="purchase"), event(10, 106), event(11, 100, user=3, kind=None)]


@pytest.mark.parametrize("finder", FINDERS)
def test_stream_equals_stored_events(spark, tmp_path, finder):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    land(spark, inbox, "a", FIRST)
    land(spark, inbox, "b", SECOND)
    assert run(spark, inbox, out, finder) == []  # all are open: the watermark is at minute 46
    tick = event(90, 600, user=99)
    land(spark, inbox, "c", [tick])
    expected = [v for v in plain(FIRST + SECOND + [tick]) if v[0] != 99]
    assert run(spark, inbox, out, finder) == expected
    # A pause of 30 minutes joins, one of 31 doesn't; of user 2 the event that came later joined two visits to one.
    assert [v[3] for v in expected if v[0] == 1] == [2, 2, 1] and [v[3:5] for v in expected if v[0] == 2] == [(3, 1)]
    assert run(spark, inbox, out, finder) == expected  # nothing is given out twice


@pytest.mark.parametrize("finder", FINDERS)
def test_late_events_change_no_visit_that_was_given_out(spark, tmp_path, finder):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    land(spark, inbox, "a", [event(1, 0), event(2, 300, user=2)])
    first = run(spark, inbox, out, finder)
    assert [v[:1] + v[3:4] for v in first] == [(1, 1)]
    land(spark, inbox, "b", [event(3, 10), event(4, 310, user=2), event(5, 305)])
    land(spark, inbox, "c", [event(9, 900, user=9)])
    after = run(spark, inbox, out, finder)
    assert [v[:1] + v[3:4] for v in after] == [(1, 1), (1, 1), (2, 2)] and set(first) <= set(after)


def test_stored_events(spark):
    events = spark.createDataFrame(FIRST + SECOND, EVENTS)
    assert rows(visits.sessions(events, "30 minutes")) == plain(FIRST + SECOND)
    assert visits.sessions(events.limit(0), "30 minutes").count() == 0


def test_segments_join_in_any_order():
    segments = [[[t, t, "v"], [t, t, "v"], 1, 0] for t in (50, 0, 9, 100, 59, 40)]
    assert [(v[0][0], v[1][0], v[2]) for v in visits._merged(segments, 10)] == [(0, 9, 2), (40, 59, 3), (100, 100, 1)]
    assert [(v[0][0], v[1][0], v[2]) for v in visits._merged(visits._merged(segments, 10) + [[[45, 1, "v"], [45, 1, "v"], 1, 0]], 10)] == [(0, 9, 2), (40, 59, 4), (100, 100, 1)]
