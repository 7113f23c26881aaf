"""Live alerts against the batch query, with scripted clocks and files in any order."""

import datetime as dt
import os
import random

import pytest

from capturemill.streaming import alerts, logs
from tests.test_streaming import CLOCK, GONE, QUIET, SILENT, START, TALK, segment


def stamped(folder, names):
    """Give files the order in which the source reads them."""
    for n, name in enumerate(names):
        os.utime(folder / name, (1_700_000_000 + 10 * n,) * 2)


def changes(spark, folder):
    rows = spark.read.parquet(str(folder)).orderBy("batch", "run_id", "version").collect()
    base = int(START.timestamp() * 1000)
    return [(r["run_id"], r["version"], r["kind"], r["reason"], (r["last_ms"] - base) // 1000, (r["due_ms"] - base) // 1000, (r["clock_ms"] - base) // 1000)
            for r in rows]


def live(spark, folder, out, silence):
    stream = logs.stream_log_lines(spark, str(folder), files_per_trigger=1)
    alerts.write_alerts(stream, str(out / "alerts"), str(out / "state"), silence).awaitTermination()
    return alerts.current_alerts(spark, str(out / "alerts"))


def batch(spark, folder, silence):
    slots = folder.parent / f"slots{silence}"
    logs.write_slots(logs.stream_log_lines(spark, str(folder)), str(slots), str(folder.parent / f"slot_state{silence}")).awaitTermination()
    return logs.stalled_runs(spark.read.parquet(str(slots)), silence=silence)


def plain(frame):
    columns = ["run_id", "tool", "reason", "started", "last_line", "alert_at"]
    return sorted(map(repr, frame.select(*columns).collect()))


@pytest.mark.parametrize("order", ["given", "reversed", "shuffled"])
def test_alerts_equal_the_batch_in_any_order(spark, tmp_path, order):
    folder = tmp_path / "in"
    rows = sorted(TALK + SILENT + QUIET + CLOCK + GONE, key=lambda r: r[3])
    names = []
    for n in range(0, len(rows), 9):
        names.append(f"{n:03d}.json")
        segment(folder, names[-1], rows[n:n + 9])
    if order == "reversed":
        names.reverse()
    elif order == "shuffled":
        random.Random(5).shuffle(names)
    stamped(folder, names)
    got = live(spark, folder, tmp_path, 3000)
    assert plain(got) == plain(batch(spark, folder, 3000))
    assert {r["run_id"] for r in got.collect()} == {1, 2, 5}


def test_alerts_are_raised_withdrawn_and_corrected_while_the_stream_goes_on(spark, tmp_path):
    """Run 1 is silent from 60 s on; the clock is moved by run 2."""
    folder = tmp_path / "in"
    script = [
        [(1, "map", 1, 0, "x"), (1, "map", 2, 60, "x"), (2, "map", 1, 0, "x")],
        [(2, "map", 2, 660, "x")],                                # at the deadline of run 1, not past it
        [(2, "map", 3, 661, "x")],                                # past it: raised
        [(2, "map", 4, 700, "x")],
        [(1, "map", 3, 400, "x")],                                # a late line: withdrawn
        [(2, "map", 5, 1200, "x")],                               # silent again since 400 s: raised with the next files
        [(2, "map", 7, 1210, "x")],
        [(1, "map", 4, 900, "x")],                                # late: withdrawn
        [(1, "map", 5, 1700, "x"), (2, "map", 6, 1750, "x")],     # spoke too late: its silence since 900 s is told
        [(1, "map", 6, 1400, "x")],                               # fills that gap: withdrawn
    ]
    names = []
    for n, rows in enumerate(script):
        names.append(f"{n}.json")
        segment(folder, names[-1], rows)
    stamped(folder, names)
    got = live(spark, folder, tmp_path, 600)
    seen = changes(spark, tmp_path / "alerts")
    first = [c[1:6] for c in seen if c[0] == 1]
    assert first == [
        (1, "raised", "silent", 60, 660), (2, "withdrawn", "silent", 60, 660), (3, "raised", "silent", 400, 1000),
        (4, "withdrawn", "silent", 400, 1000), (5, "raised", "silent", 900, 1500), (6, "withdrawn", "silent", 900, 1500),
    ]
    assert next(c[6] for c in seen if c[0] == 1) == 661  # as soon as the clock is past the deadline
    assert plain(got) == plain(batch(spark, folder, 600))


def test_a_retried_stream_goes_on_from_its_state(spark, tmp_path):
    """A stream that is stopped and started again keeps its slots, timers and versions."""
    folder = tmp_path / "in"
    for n, rows in enumerate([[(1, "map", 1, 0, "x")], [(2, "map", 1, 900, "x")], [(1, "map", 2, 500, "x"), (2, "map", 2, 1000, "x")], [(2, "map", 3, 1101, "x")]]):
        segment(folder, f"{n}.json", rows)
        stamped(folder, [f"{i}.json" for i in range(n + 1)])
        got = live(spark, folder, tmp_path, 600)
    assert [c[:4] for c in changes(spark, tmp_path / "alerts") if c[0] == 1] == [
        (1, 1, "raised", "silent"), (1, 2, "withdrawn", "silent"), (1, 3, "raised", "silent")]
    assert plain(got) == plain(batch(spark, folder, 600))


def test_stall_equals_slots_read_one_by_one():
    draw = random.Random(3)
    for _ in range(300):
        times = sorted({draw.randrange(0, 40_000) for _ in range(draw.randrange(1, 12))})
        spans = {}
        for t in times:
            spans.setdefault(t // 600, []).append(t)
        slots = [(v[0], v[-1]) for _, v in sorted(spans.items())]
        clock = max(times) + draw.randrange(0, 9_000)
        limit, silence = draw.randrange(1_000, 50_000), draw.randrange(700, 9_000)
        alert, due = alerts.stall(slots, limit, silence, clock)
        late = [(f, last, nxt) for (f, last), nxt in zip(slots, [s[0] for s in slots[1:]] + [clock], strict=True)
                if nxt > min(times[0] + limit, last + silence) or last > times[0] + limit]
        assert (alert is None) == (not late)
        if late:
            assert (alert.last, alert.due) == (late[0][1], min(times[0] + limit, late[0][1] + silence))
        else:
            assert due >= clock


def test_lines_without_a_time_or_a_run(spark, tmp_path):
    folder = tmp_path / "in"
    segment(folder, "0.json", [(1, "map", 1, 0, "x"), (2, "bundle", 1, 5000, "x")])
    (folder / "1.json").write_text('{"run_id": 3, "tool": "map", "seq": 1, "line": "x"}\n{"tool": "map", "seq": 1, "ts": "%s", "line": "x"}\n'
                                   % (START + dt.timedelta(seconds=10)).isoformat())
    stamped(folder, ["0.json", "1.json"])
    got = live(spark, folder, tmp_path, 600)
    assert {(r["run_id"], r["tool"]) for r in got.collect()} == {(1, "map"), (None, "map")}


def test_a_batch_of_a_run_costs_few_calls_of_its_state():
    """Each call is a round trip; their number must not grow with the slots of a run."""
    calls = []

    class State:
        value = None

        def exists(self):
            return calls.append("exists") or self.value is not None

        def get(self):
            return calls.append("get") or self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            calls.append("timer")

        def deleteTimer(self, at):
            calls.append("no timer")

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    processor = alerts.StallProcessor(3600)
    processor.init(Handle())
    rows = [{"at": minute * 60_000} for minute in range(50)]
    assert list(processor.handleInputRows((1, "map"), rows, Clock())) == [] and len(calls) == 3
    assert list(processor.handleInputRows((1, "map"), rows, Clock())) == [] and len(calls) == 4
