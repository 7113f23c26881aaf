"""Counters of runs that go on, each line counted once, with a state that stays small.

The numbers of the lines seen so far are kept as intervals: a run whose lines come in order has one interval however long it
talks, and a gap between two closes as soon as the lines in it have come.  So a line delivered twice is known at any age, and
no line is dropped for being late.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from capturemill.operators.logs import LAST_COUNTERS, classify, counter_columns, run_metrics

# Counter of the output and the column it is folded from.
COUNTS = {"matched_lines": "matched", "feature_images": "features", "match_pairs": "matches"}
SUMS = {"feature_total": "features", "match_total": "matches", "triangulated_points": "triangulated", "depth_maps": "depth_maps"}

# Where the intervals begin and end, if there are more than a few.
SPANS = ("firsts", "lasts")
FEW = 4


def merged(spans: list[tuple[int, int]], fresh: list[int]) -> list[tuple[int, int]]:
    """Intervals (first, last) in ascending order, none next to another, of some intervals and numbers outside of them."""
    out: list[tuple[int, int]] = []
    for first, last in sorted([*spans, *((n, n) for n in fresh)]):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


class Seen:
    """Numbers known already: intervals, and what this batch has added."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.spans = sorted(spans)
        self.firsts = [first for first, _ in self.spans]
        self.fresh: set[int] = set()

    def add(self, number: int) -> bool:
        """Whether the number is new."""
        at = bisect_right(self.firsts, number)
        if number in self.fresh or (at and number <= self.spans[at - 1][1]):
            return False
        self.fresh.add(number)
        return True


class CounterProcessor(StatefulProcessor):
    """State of one run and tool: intervals of line numbers, the counters, and the line that set each latest value.

    Each call of a state is a round trip between Python and the store.  So only a few intervals are entries of a map, which
    a batch changes one by one; of a run with more, all are lists of the value that holds the counters.
    """

    def __init__(self, result: StructType, keep_seconds: int | None):
        self.names = [f.name for f in result.fields[2:]]
        types = {f.name: f.dataType for f in result.fields}
        # lines without a number count once, like lines that share one
        self.state = StructType([
            *result.fields[2:], *[StructField(n, LongType()) for n in (*[f"{n}_seq" for n in LAST_COUNTERS], "unnumbered")],
            *[StructField(n, ArrayType(LongType())) for n in SPANS]])
        assert all(n in types for n in (*COUNTS, *SUMS, *LAST_COUNTERS))
        self.keep = None if keep_seconds is None else keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getMapState("spans", "first bigint", "last bigint", self.keep)
        self.counters = handle.getValueState("counters", self.state, self.keep)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        fields = self.state.fieldNames()
        before = self.counters.get()
        held = dict(zip(fields, before or [None] * len(fields), strict=True))
        listed = held["firsts"] is not None
        mapped = {(k[0], v[0]) for k, v in self.spans.iterator()} if before is not None and not listed else set()
        seen, some = Seen(zip(*(held[n] for n in SPANS), strict=True) if listed else mapped), False
        for values in rows:
            row = {"seq": values["seq"], **json.loads(values["told"])}
            if row["seq"] is None:
                if held["unnumbered"]:
                    continue
                held["unnumbered"] = 1
            elif not seen.add(row["seq"]):
                continue
            some = True
            self._count(held, row)
        if not some:
            return
        after = merged(seen.spans, sorted(seen.fresh))
        few = set(after) if len(after) <= FEW else set()
        for first in {first for first, _ in mapped} - {first for first, _ in few}:
            self.spans.removeKey((first,))
        for first, last in few - mapped:
            self.spans.updateValue((first,), (last,))
        held |= zip(SPANS, (None if few else [span[end] for span in after] for end in (0, 1)), strict=True)
        self.counters.update(tuple(held[f] for f in fields))
        yield Row(**dict(zip(("run_id", "tool"), key)), **{n: held[n] for n in self.names})

    def _count(self, held: dict, row: dict) -> None:
        held["lines"] = (held["lines"] or 0) + 1
        for name, column in COUNTS.items():
            held[name] = (held[name] or 0) + (column in row)
        for name, column in SUMS.items():
            if column in row:
                held[name] = (held[name] or 0) + row[column]
        if (features := row.get("features")) is not None:
            held["feature_min"] = features if held["feature_min"] is None else min(held["feature_min"], features)
            held["feature_max"] = features if held["feature_max"] is None else max(held["feature_max"], features)
        for name in LAST_COUNTERS:
            before = held[f"{name}_seq"]
            if name in row and row["seq"] is not None and (before is None or row["seq"] > before):
                # JSON tells an infinite number as text
                held[name], held[f"{name}_seq"] = float(row[name]) if name == "mean_error" else row[name], row["seq"]

    def close(self) -> None:
        pass


def counted_runs(lines: DataFrame, keep_seconds: int | None = None) -> DataFrame:
    """Counters per run and tool, kept up to date as lines arrive (update mode); see the module text.

    Lines are classified by Spark; a state holds some twenty numbers and the intervals.  ``keep_seconds`` lets the
    state of a run go that long after its last line was handled: a line repeated later than that counts again.  Such a stream
    runs by processing time, so it goes on until it is stopped and needs a trigger that does.
    """
    spark = lines.sparkSession
    result = run_metrics(spark.createDataFrame([], lines.schema)).schema
    columns = counter_columns()
    needed = {**columns, "matched": F.col("rule")}
    # a line feeds one or two counters of a dozen, and Python pays for every column of a row: what it tells goes as one text
    told = F.to_json(F.struct(*[c.alias(n) for n, c in needed.items()]), {"ignoreNullFields": "true"}).alias("told")
    counted = classify(lines).select("run_id", "tool", "seq", told)
    return counted.groupBy("run_id", "tool").transformWithState(
        statefulProcessor=CounterProcessor(result, keep_seconds), outputStructType=result, outputMode="Update",
        timeMode="None" if keep_seconds is None else "ProcessingTime")
