"""Log segments as a stream against the batch operators."""

import datetime as dt
import json
import os
import random
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Row
from pyspark.sql import functions as F

from capturemill.operators import logs as batch
from capturemill.plans import CATALOG
from capturemill.plans.lenses import lens
from capturemill.streaming import counters, logs

START = dt.datetime(2026, 3, 1, 8, 0, 0, tzinfo=dt.timezone.utc)


def segment(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(
        json.dumps({"run_id": r, "tool": t, "seq": s, "ts": (START + dt.timedelta(seconds=at)).isoformat(), "line": line}) + "\n"
        for r, t, s, at, line in rows))


def test_stream_metrics_equal_batch_over_many_segments(spark, sf_dir, tmp_path):
    lines = lens(spark, sf_dir, "log_lines").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts")
    rows = lines.toPandas()
    rows["ts"] = rows["ts"].map(lambda t: t.isoformat())
    folder = tmp_path / "segments"
    folder.mkdir()
    for n in range(4):
        part = rows.iloc[n::4] if n else rows.iloc[: len(rows)]
        part.to_json(folder / f"{n}.json", orient="records", lines=True)
    stream = logs.stream_log_lines(spark, str(folder), files_per_trigger=1)
    logs.write_updates(logs.stream_run_metrics(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = logs.latest_updates(spark, str(tmp_path / "out"), ["run_id", "tool"])
    want = batch.run_metrics(lines)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_stream_trims_and_classifies(spark, tmp_path):
    segment(tmp_path / "in", "0.json", [(1, "map", 1, 0, "  Triangulated 5 points \t"), (1, "map", 2, 1, "   ")])
    stream = logs.stream_classify(logs.stream_log_lines(spark, str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["line"], r["rule"], r["n1"]) for r in rows] == [("Triangulated 5 points", "T12", 5)]


def updates_of(spark, folder, out, **options):
    stream = logs.stream_run_metrics(logs.stream_log_lines(spark, str(folder), files_per_trigger=1))
    logs.write_updates(stream, f"{out}/updates", f"{out}/state", ["run_id", "tool"], **options).awaitTermination()
    return logs.latest_updates(spark, f"{out}/updates", ["run_id", "tool"])


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_in_any_order_and_delivered_twice_count_once(spark, sf_dir, tmp_path, seed):
    """Lines dealt at random to files, a third of them twice; some without a number."""
    draw = random.Random(seed)
    lines = lens(spark, sf_dir, "log_lines").withColumn("ts", F.col("ts").cast("timestamp")).where("run_id % 5 = 0")
    rows = [json.dumps({**r.asDict(), "ts": r["ts"].isoformat()}) for r in lines.collect()]
    rows += draw.sample(rows, len(rows) // 3) + [json.dumps({"run_id": 5, "tool": "map", "line": "Triangulated 5 points", "ts": START.isoformat()})] * 2
    draw.shuffle(rows)
    (tmp_path / "in").mkdir()
    for n in range(5):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(rows[n::5]) + "\n")
    got = updates_of(spark, tmp_path / "in", tmp_path, fold=2)
    once = spark.read.schema(logs.LOG_LINES).json(str(tmp_path / "in")).dropDuplicates(["run_id", "tool", "seq"])
    want = batch.run_metrics(logs.trimmed(once))
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert got.schema == want.schema or [f.dataType for f in got.select(*want.columns).schema] == [f.dataType for f in want.schema]
    # newest rows were gathered twice, and readers open the newest gathering and the batches after it
    assert logs._folds(spark, f"{tmp_path}/updates") == [1, 3]


def test_intervals_of_line_numbers():
    draw = random.Random(4)
    spans, known = [], set()
    for _ in range(60):
        numbers = [draw.randrange(200) for _ in range(draw.randrange(1, 12))]
        seen = counters.Seen(spans)
        new = [n for n in numbers if seen.add(n)]
        assert new == [n for i, n in enumerate(numbers) if n not in known and n not in numbers[:i]]
        known |= set(numbers)
        spans = counters.merged(spans, sorted(seen.fresh))
        assert {n for a, b in spans for n in range(a, b + 1)} == known
        assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert counters.merged([], list(range(1, 10_001))) == [(1, 10_000)]


def test_a_run_in_order_keeps_one_interval(spark, tmp_path):
    for n, numbers in enumerate([range(1, 40), range(40, 80), range(85, 90), range(80, 85)]):
        segment(tmp_path / "in", f"{n}.json", [(1, "map", s, s, "Triangulated 5 points") for s in numbers])
        os.utime(tmp_path / "in" / f"{n}.json", (1_700_000_000 + n,) * 2)
        got = updates_of(spark, tmp_path / "in", tmp_path).first()
        spans = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "spans").load()
        held = sorted((r["user_map_key"]["first"], r["user_map_value"]["last"]) for r in spans.collect())
        assert held == [[(1, 39)], [(1, 79)], [(1, 79), (85, 89)], [(1, 89)]][n]
    assert (got["lines"], got["triangulated_points"]) == (89, 445)


def test_state_with_a_time_to_live(spark, tmp_path):
    """Such a state needs a trigger that goes on: its batches do not end with the input."""
    segment(tmp_path / "in", "0.json", [(1, "map", 1, 0, "Triangulated 5 points"), (1, "map", 1, 0, "Triangulated 5 points")])
    stream = logs.stream_run_metrics(logs.stream_log_lines(spark, str(tmp_path / "in")), keep_seconds=3600)
    running = logs.write_updates(stream, f"{tmp_path}/updates", f"{tmp_path}/state", ["run_id", "tool"], processingTime="1 second")
    try:
        until = time.time() + 60
        while time.time() < until and not os.path.exists(tmp_path / "updates" / "batch=0" / "_SUCCESS"):
            time.sleep(0.5)
    finally:
        running.stop()
    assert logs.latest_updates(spark, f"{tmp_path}/updates", ["run_id", "tool"]).first()["triangulated_points"] == 5


HOUR = 3600
# run 1 talks until its mapper limit is passed; run 2 falls silent and later speaks again; run 3 is quiet at the end but
# within the limit of silence; run 4 only moves the clock on; run 5 never speaks again, which only the clock shows.
TALK = [(1, "map", i, i * 300, "x") for i in range(14)]
SILENT = [(2, "match", i, i * 60, "x") for i in range(5)] + [(2, "match", 9, 2 * HOUR, "back")]
QUIET = [(3, "densify", i, HOUR + i * 500, "x") for i in range(3)]
CLOCK = [(4, "bundle", 1, HOUR + 3900, "x")]
GONE = [(5, "extract", i, i * 10, "x") for i in range(4)]


@pytest.mark.parametrize("order", ["given", "reversed", "shuffled", "equal times"])
def test_stalled_runs_in_any_order(spark, tmp_path, order):
    folder = tmp_path / "in"
    rows = sorted(TALK + SILENT + QUIET + CLOCK + GONE, key=lambda r: r[3])
    names = [f"{n:03d}.json" for n in range(0, len(rows), 5)]
    for name, n in zip(names, range(0, len(rows), 5), strict=True):
        segment(folder, name, rows[n:n + 5])
    if order == "reversed":
        names.reverse()
    elif order == "shuffled":
        random.Random(3).shuffle(names)
    for n, name in enumerate(names):
        at = 1_700_000_000 + (0 if order == "equal times" else 10 * n)
        os.utime(folder / name, (at, at))
    stream = logs.stream_log_lines(spark, str(folder), files_per_trigger=1)
    logs.write_slots(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    alerts = {r["run_id"]: r for r in logs.stalled_runs(spark.read.parquet(str(tmp_path / "out")), silence=3000).collect()}
    assert set(alerts) == {1, 2, 5}
    seconds = lambda t: int(t.timestamp()) - int(START.timestamp())
    assert (alerts[1]["reason"], seconds(alerts[1]["alert_at"])) == ("over_limit", 3600)
    assert (alerts[2]["reason"], seconds(alerts[2]["alert_at"]), seconds(alerts[2]["last_line"])) == ("silent", 3240, 240)
    assert (alerts[5]["reason"], seconds(alerts[5]["alert_at"]), seconds(alerts[5]["last_line"])) == ("silent", 3030, 30)


def test_streams_read_a_table_of_part_files(spark, sf_dir, tmp_path):
    whole = spark.read.parquet(f"{sf_dir}/events.parquet")
    whole.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = CATALOG["stream_classify"].run(spark, str(tmp_path))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, CATALOG["stream_classify"].run(spark, sf_dir).collect()))
    assert got.count() > 0
    with pytest.raises(AnalysisException):
        CATALOG["stream_classify"].run(spark, str(tmp_path / "nothing"))


class CountedState:
    """The state of one key in memory, and the calls that reach it."""

    def __init__(self):
        self.value, self.entries, self.calls = None, {}, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            return {
                "get": lambda: self.value, "exists": lambda: self.value is not None, "update": lambda v: setattr(self, "value", v),
                "iterator": lambda: iter(list(self.entries.items())), "updateValue": lambda k, v: self.entries.__setitem__(k, v),
                "removeKey": lambda k: self.entries.pop(k),
            }[name](*args)

        return call


def test_a_run_with_gaps_costs_few_calls_of_its_state(spark):
    """Calls of a state are round trips: their number does not grow with the intervals of a run."""
    lines = spark.createDataFrame([], "run_id bigint, tool string, seq bigint, ts timestamp, line string")
    from capturemill.operators.logs import run_metrics
    counter = counters.CounterProcessor(run_metrics(lines).schema, None)
    state, spans = CountedState(), CountedState()
    counter.counters, counter.spans = state, spans
    told = '{"matched":"T12","triangulated":5}'

    def batch(numbers):
        state.calls = spans.calls = 0
        got = list(counter.handleInputRows((1, "map"), iter([Row(seq=n, told=told) for n in numbers]), None))
        assert state.calls + spans.calls <= 2 + counters.FEW
        return got[0]["lines"] if got else None

    assert batch(range(0, 200, 2)) == 100
    assert batch(range(0, 200, 2)) is None
    assert batch(range(1, 180, 2)) == 190
    assert sum(last - first + 1 for (first,), (last,) in spans.entries.items()) in (0, 190)
    assert batch(range(181, 200, 2)) == 200
    assert spans.entries == {(0,): (199,)}
    assert batch([50, 199, 200]) == 201
    assert spans.entries == {(0,): (200,)}
    assert batch(range(300, 340, 10)) == 205
    assert batch([300, 310, 200, 5]) is None
    assert not spans.entries
