"""Ranges of variable-length records of large files, found without reading a file from its front.

Where a record begins is known only from the one before it.  Each byte range of a file therefore follows the chains of records from
all places near its front, in one task: chains that meet are one from there on, chains that make no sense end, and what is left
tells for each place of entry where the next range is entered.  Mostly the true chain is among them.  A place that some chain
leads to and no range has followed is followed in another round.  A walk from range to range, over these few links, then
picks the chain that begins at the first record.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturemill.session import checkpointed
from capturemill.sources.ranges import file_system

# A step gives the place after the record at a place, or None if no record can be there.
Step = Callable[["Reader", int], int | None]

# Places at the front of a range from which chains are followed; long records need more.
WINDOW = 2_048
# Where more than so many chains are left after so many bytes, a range is left to the next round.
MOST_CHAINS, PATIENCE = 8, 1 << 20
BLOCK = 4 << 20

LINKS = "path string, entry bigint, exit bigint, records bigint"


class Reader:
    """Bytes at any place of one file, through a buffer that moves forward."""

    def __init__(self, path: str):
        system, inner = file_system(path)
        self._file = system.open_input_file(inner)
        self.size = self._file.size()
        # the block read last and the one before it, for chains that are a little behind
        self._blocks: list[tuple[int, bytes]] = []
        self.bytes_read = 0

    def take(self, place: int, n: int) -> bytes:
        """n bytes at a place, fewer at the end of the file."""
        for base, data in self._blocks:
            if base <= place and place + n <= base + len(data):
                return data[place - base:place - base + n]
        if place >= self.size:
            return b""
        ahead = not self._blocks or place >= self._blocks[0][0]
        block = self._file.read_at(max(n, BLOCK) if ahead else n, place)
        self.bytes_read += len(block)
        if ahead:
            self._blocks = [(place, block), *self._blocks[:1]]
        return block[:n]

    def number(self, place: int, n: int) -> int | None:
        """Unsigned little-endian number of n bytes; None past the end of the file."""
        raw = self.take(place, n)
        return int.from_bytes(raw, "little") if len(raw) == n else None

    def close(self) -> None:
        self._file.close()


def followed(reader: Reader, step: Step, places: Iterator[int], end: int, patience: int = PATIENCE) -> list[tuple[int, int, int]]:
    """Links (entry, exit, records) of the chains from some places to the first record at ``end`` or after it.

    The chain that is farthest behind moves first, so two chains meet wherever they share a record.
    """
    members = {place: (0, [(place, 0)]) for place in places}  # place -> records so far, (entry, records it has more)
    front = sorted(members)
    first, out = (front[0] if front else 0), []
    while front:
        place = heapq.heappop(front)
        records, entries = members.pop(place)
        if place >= end:
            out += [(entry, place, records + more) for entry, more in entries]
            continue
        if place > first + patience and len(front) >= MOST_CHAINS:
            return []
        after = step(reader, place)
        if after is None:
            continue
        records += 1
        if after in members:
            others, held = members[after]
            held += [(entry, more + records - others) for entry, more in entries]
        else:
            members[after] = (records, entries)
            heapq.heappush(front, after)
    return out


def hopped(reader: Reader, step: Step, entry: int, end: int) -> tuple[int, int | None, int]:
    """The link of one entry, by hopping; the exit is None where the chain breaks off."""
    place, records = entry, 0
    while place < end:
        after = step(reader, place)
        if after is None:
            return entry, None, records
        place, records = after, records + 1
    return entry, place, records


def record_ranges(files: DataFrame, step_of: Callable[[str | None], Step], split: int, window: int = WINDOW) -> DataFrame:
    """Ranges (path, at, records) of about ``split`` bytes over the records of files (path, size, start, count, layout).

    ``step_of`` gives the step of a layout.  All records of a damaged file from the damage on are in its last range.
    """
    def own_end(start: int, place: int) -> int:
        return start + ((place - start) // split + 1) * split

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, layout, at in zip(batch["path"], batch["start"], batch["layout"], batch["at"], strict=True):
                reader = Reader(path)
                try:
                    places = [at] if at == start else range(at, min(at + min(window, split), reader.size))
                    links = followed(reader, step_of(layout), places, at + split)
                finally:
                    reader.close()
                yield pd.DataFrame([(path, *link) for link in links], columns=["path", "entry", "exit", "records"])

    def hop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, layout, reach, entry in zip(batch["path"], batch["start"], batch["layout"], batch["reach"], batch["entry"], strict=True):
                reader = Reader(path)
                try:
                    link = hopped(reader, step_of(layout), entry, own_end(start, entry) + (reach - 1) * split)
                finally:
                    reader.close()
                yield pd.DataFrame([(path, *link)], columns=["path", "entry", "exit", "records"]).astype({"exit": "Int64"})

    def walk(key: tuple, links: pd.DataFrame) -> pd.DataFrame:
        """The chain of one file; a file has a few dozen links per range."""
        size, start, count = (int(links[c].iloc[0]) for c in ("size", "start", "count"))
        links = links[links["entry"].notna()]
        ahead = {e: (None if pd.isna(x) else int(x), int(n)) for e, x, n in zip(links["entry"], links["exit"], links["records"], strict=True)}
        rows, place, left = [], start, count
        while left and place is not None and place < size:
            after, records = ahead[place]
            # a chain that breaks off leaves the rest to its range
            records = left if after is None or after >= size else min(records, left)
            rows.append((key[0], place, records))
            place, left = after, left - records
        if left and not rows:
            rows.append((key[0], start, left))
        return pd.DataFrame(rows, columns=["path", "at", "records"])

    tasks = files.sparkSession.sparkContext.defaultParallelism
    ranges = files.where("start < size").withColumn("at", F.explode(F.sequence("start", F.col("size") - 1, F.lit(split).cast("long"))))
    links = checkpointed(ranges.select("path", "start", "layout", "at").repartition(tasks, "path", "at").mapInPandas(guess, LINKS))
    reach = 1
    while True:
        entered = links.select("path", F.col("exit").alias("entry")).union(files.select("path", F.col("start").alias("entry"))).distinct()
        missing = checkpointed(entered.join(links, ["path", "entry"], "left_anti").join(
            files.select("path", "start", "size", "layout"), "path").where("entry < size").withColumn("reach", F.lit(reach).cast("long")))
        if not missing.limit(1).count():
            break
        links = checkpointed(links.unionByName(missing.repartition(tasks, "path", "entry").mapInPandas(hop, LINKS)))
        reach *= 2  # of ranges in a row that none has followed, each round takes twice as many
    used = links.join(entered, ["path", "entry"], "left_semi")
    return files.where("count > 0").join(used, "path", "left").groupBy("path").applyInPandas(walk, "path string, at bigint, records bigint")
