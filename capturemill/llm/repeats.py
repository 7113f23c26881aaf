"""Removing repeated passages: every byte covered by a ``LENGTH``-byte string that also starts earlier.

Each ``LENGTH``-byte window of a text picks the k-gram of smallest hash inside it as its anchor, so equal windows
pick equal anchors at equal places, and a run of windows shares an anchor.  Anchors are compared by hash range;
only runs whose anchor occurs twice or more send their bytes on.  Where these differ, the texts from the anchors
on are put into one sequence of 25-byte blocks, and its suffix array (``suffixes``) brings equal beginnings together.
The common prefix of neighbours and the bytes before the anchor then tell which windows are equal.

Texts travel in chunks: a chunk file in the shared folder holds the documents of a few megabytes with their
runs.  Inside a chunk runs with equal bytes are settled at once, so a passage that many documents share sends one
run per chunk.  Anchors that still meet more than ``HOT_RUNS`` times are settled window by window.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturemill.llm.common import byte_texts, gather_runs, releasing, releasing_groups, saved, scratch, slices
from capturemill.llm.suffixes import suffix_array
from capturemill.sources.ranges import file_system

LENGTH = 100
GRAM = 32
WINDOW_GRAMS = LENGTH - GRAM + 1  # k-grams in a window, so an anchor lies 0 to 68 bytes behind a window's start
BEFORE = WINDOW_GRAMS - 1
BLOCK = 25
CHUNK_BYTES = 4 << 20
STEP = 1 << 18  # window starts handled at a time
TEXT_ROWS = 2_000  # texts a Python step gets at a time
HOT_RUNS = 50_000

_DRAW = np.random.default_rng(77)
BYTE_HASH = _DRAW.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
POWERS = [np.uint64(pow(int(BASE), 1 << n, 1 << 64)) for n in range(5)]
MIX = np.uint64(0xD6E8FEB86659FD93)
PLACE_BITS = np.uint64(23)

# An anchored run as it meets others: document and place order it, the anchor lies ``off`` behind the first of
# ``n`` windows, and those are the windows from ``at`` on of run ``run`` in its chunk.
MEETING = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("ordinal", "<u4"), ("anchor", "<u8"), ("run", "<u4"), ("off", "u1"), ("n", "u1"), ("at", "u1")])
SENT = np.dtype([("hash", "<u8"), ("run", "<u4")])
SETTLED = np.dtype([("run", "<u4"), ("bits", "u1", ((WINDOW_GRAMS + 7) // 8,))])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling."""
    h = BYTE_HASH[data]
    for n, power in enumerate(POWERS):
        h = h[:-(1 << n)] * power + h[1 << n:]
    h ^= h >> np.uint64(31)
    h *= MIX
    h ^= h >> np.uint64(29)
    return h


def anchored_runs(data: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor in a row of texts: text, first and last window, anchor.

    A window's anchor is the first of its k-grams whose hash is smallest in its upper 41 bits.  Windows are handled
    ``STEP`` at a time, so only runs are held for the whole row.
    """
    starts = np.cumsum(sizes) - sizes
    stops = starts + np.maximum(sizes - LENGTH + 1, 0)
    parts: list[np.ndarray] = []
    for low in range(0, len(data) - LENGTH + 1, STEP):
        x = gram_hashes(data[low:low + STEP + LENGTH - 1])
        x >>= PLACE_BITS
        x <<= PLACE_BITS
        x |= np.arange(len(x), dtype=np.uint64)
        for shift in (1, 2, 4, 8, 16, 32, WINDOW_GRAMS - 64):
            x = np.minimum(x[:-shift], x[shift:])
        high = low + len(x)
        near = np.arange(np.searchsorted(stops, low, side="right"), np.searchsorted(starts, high))
        begin = np.maximum(starts[near], low)
        count = np.maximum(np.minimum(stops[near], high) - begin, 0)
        window = gather_runs(begin, count)
        text = np.repeat(near, count)
        anchor = (x[window - low] & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64) + low
        if len(window):
            opens = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
            closes = np.append(opens[1:], len(window)) - 1
            parts.append(np.stack([text[opens], window[opens], window[closes], anchor[opens]]))
    runs = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
    # a run that goes over from one step to the next is one
    fresh = np.concatenate([[True], (runs[0, 1:] != runs[0, :-1]) | (runs[3, 1:] != runs[3, :-1])])[:runs.shape[1]]
    at = np.flatnonzero(fresh)
    return {"text": runs[0, at], "first": runs[1, at], "last": np.maximum.reduceat(runs[2], at) if len(at) else runs[2], "anchor": runs[3, at]}


class Chunk:
    """Documents of a slice in order of their ids, with their runs; ``settled`` runs repeat an earlier run of the chunk."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, runs: dict[str, np.ndarray], settled: np.ndarray, rows: pa.Table):
        self.data, self.sizes, self.ids, self.runs, self.settled, self.rows = data, sizes, ids, runs, settled, rows
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, texts: list[bytes], ids: np.ndarray, rows: pa.Table) -> Chunk:
        order = np.argsort(ids, kind="stable")
        texts = [texts[i] for i in order.tolist()]
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        runs = anchored_runs(data, sizes)
        view = memoryview(data)
        digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b + LENGTH]) for a, b in zip(runs["first"].tolist(), runs["last"].tolist(), strict=True)), np.uint64, len(runs["first"]))
        key = (digest ^ (runs["anchor"] - runs["first"]).astype(np.uint64)) * MIX
        settled = np.ones(len(key), bool)
        settled[np.unique(key, return_index=True)[1]] = False
        return cls(data, sizes, ids[order], runs, settled, rows.take(pa.array(order)))

    def write(self, path: str) -> None:
        """One compressed file: the carried rows, and arrays.  Runs of a text follow each other, so their lengths say where they are."""
        held = io.BytesIO()
        first, last, anchor = (self.runs[k] for k in ("first", "last", "anchor"))
        np.savez(held, data=self.data, sizes=self.sizes, ids=self.ids, runs=np.bincount(self.runs["text"], minlength=len(self.sizes)).astype(np.uint32),
                 windows=(last - first + 1).astype(np.uint8), off=(anchor - first).astype(np.uint8), settled=np.packbits(self.settled))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.rows.schema) as out:
            out.write_table(self.rows)
        rows = sink.getvalue().to_pybytes()
        system, inner = file_system(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner, compression=None) as file:
            file.write(zstandard.compress(len(rows).to_bytes(8, "little") + rows + held.getbuffer(), 3))

    @classmethod
    def read(cls, path: str) -> Chunk:
        system, inner = file_system(path)
        with system.open_input_stream(inner, compression=None) as file:
            whole = zstandard.decompress(file.read())
        size = int.from_bytes(whole[:8], "little")
        rows = pa.ipc.open_stream(whole[8:8 + size]).read_all()
        held = np.load(io.BytesIO(memoryview(whole)[8 + size:]))
        sizes, windows = held["sizes"], held["windows"].astype(np.int64)
        text = np.repeat(np.arange(len(sizes)), held["runs"])
        before = np.cumsum(windows) - windows
        opens = np.cumsum(held["runs"].astype(np.int64)) - held["runs"]
        first = (np.cumsum(sizes) - sizes)[text] + before - before[np.minimum(opens, max(len(before) - 1, 0))][text] if len(text) else text
        runs = {"text": text, "first": first, "last": first + windows - 1, "anchor": first + held["off"]}
        return cls(held["data"], sizes, held["ids"], runs, np.unpackbits(held["settled"], count=len(first)).astype(bool), rows)


def write_chunks(docs: DataFrame, carry: list[str], chunk_bytes: int) -> DataFrame:
    """Write the chunk files; gives their names, saved."""
    folder = scratch(docs.sparkSession, "chunks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch["__text"]), 0).to_pylist()
            ids, rows = batch["__id"].to_numpy(), pa.Table.from_batches([batch.select(carry)])
            for low, high in slices(lengths, chunk_bytes):
                path = f"{folder}/{uuid.uuid4().hex}"
                Chunk.of(byte_texts(batch["__text"].slice(low, high - low)), ids[low:high], rows.slice(low, high - low)).write(path)
                yield pa.RecordBatch.from_pydict({"chunk": [path]})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__id"), F.col("text").alias("__text"), *[f"`{c}`" for c in carry])
    return saved(rows.mapInArrow(releasing(cut), "chunk string"), "chunks", TEXT_ROWS)


def sent_runs(chunks: DataFrame, range_bits: int) -> DataFrame:
    """What each chunk sends to each hash range: (chunk, span, runs), the hashes and numbers of its runs that are not settled."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["chunk"].to_pylist():
                chunk = Chunk.read(path)
                free = np.flatnonzero(~chunk.settled)
                hashes = _hash_at(chunk.data, chunk.runs["anchor"][free])
                order = np.argsort(hashes)
                sent = np.empty(len(order), SENT)
                sent["hash"], sent["run"] = hashes[order], free[order]
                span = (sent["hash"] >> np.uint64(64 - range_bits)).astype(np.int64)
                edges = np.flatnonzero(np.concatenate([[True], span[1:] != span[:-1]])) if len(span) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({
                    "chunk": [path] * len(edges), "span": span[edges].tolist(),
                    "runs": [part.tobytes() for part in np.split(sent, edges[1:])] if len(edges) else []},
                    schema=pa.schema([("chunk", pa.string()), ("span", pa.int64()), ("runs", pa.binary())]))

    return chunks.mapInArrow(releasing(send), "chunk string, span bigint, runs binary")


def repeated_runs(sent: DataFrame, hot_runs: int) -> DataFrame:
    """(chunk, runs, hot): the runs of each chunk whose anchors occur again anywhere."""
    def pick(table: pa.Table) -> pa.Table:
        blobs = table["runs"].to_pylist()
        parts = [np.frombuffer(b, SENT) for b in blobs]
        every = np.concatenate(parts)
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        _, where, counts = np.unique(every["hash"], return_inverse=True, return_counts=True)
        times = counts[where]
        out = {"chunk": [], "runs": [], "hot": []}
        names = table["chunk"].to_pylist()
        chosen = np.flatnonzero(times > 1)
        for part in np.split(chosen, np.flatnonzero(np.diff(of[chosen])) + 1) if len(chosen) else []:
            out["chunk"].append(names[of[part[0]]])
            out["runs"].append(every["run"][part].tobytes())
            out["hot"].append(np.packbits(times[part] > hot_runs).tobytes())
        return pa.table(out, schema=pa.schema([("chunk", pa.string()), ("runs", pa.binary()), ("hot", pa.binary())]))

    return sent.groupBy("span").applyInArrow(releasing_groups(pick), "chunk string, runs binary, hot binary")


def meetings(repeated: DataFrame, range_bits: int) -> DataFrame:
    """(chunk, span, runs, bytes): repeated runs with the bytes their windows cover, sent to the range of the hash."""
    def send(table: pa.Table) -> pa.Table:
        path = table["chunk"][0].as_py()
        chunk = Chunk.read(path)
        runs = [np.frombuffer(b, "<u4") for b in table["runs"].to_pylist()]
        hot = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(r)) for b, r in zip(table["hot"].to_pylist(), runs, strict=True)]).astype(bool)
        run = np.concatenate(runs).astype(np.int64)
        first, last, anchor, text = (chunk.runs[k][run] for k in ("first", "last", "anchor", "text"))
        plain = ~hot
        meet = np.zeros(int(plain.sum()), MEETING)
        meet["run"], meet["anchor"] = run[plain], (anchor - chunk.starts[text])[plain]
        meet["doc"], meet["ordinal"] = chunk.ids[text[plain]], text[plain]
        meet["off"], meet["n"] = (anchor - first)[plain], (last - first + 1)[plain]
        at = anchor[plain]
        meet["hash"] = _hash_at(chunk.data, at)
        if hot.any():  # each window is an anchor of its own, named by its own bytes
            lengths = (last - first + 1)[hot]
            window = gather_runs(first[hot], lengths)
            own = np.repeat(np.flatnonzero(hot), lengths)
            more = np.zeros(len(window), MEETING)
            more["run"], more["anchor"], more["n"] = run[own], window - chunk.starts[text[own]], 1
            more["doc"], more["ordinal"], more["at"] = chunk.ids[text[own]], text[own], window - first[own]
            view = memoryview(chunk.data)
            more["hash"] = np.fromiter((xxhash.xxh3_64_intdigest(view[w:w + LENGTH]) for w in window.tolist()), np.uint64, len(window))
            meet, at = np.concatenate([meet, more]), np.concatenate([at, window])
        order = np.argsort(meet["hash"], kind="stable")
        meet, at = meet[order], at[order]
        span = (meet["hash"] >> np.uint64(64 - range_bits)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], span[1:] != span[:-1]]))
        bounds = [*edges.tolist(), len(span)]
        return pa.table({
            "chunk": [path] * len(edges), "span": span[edges].tolist(), "runs": [meet[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
            "bytes": [zstandard.compress(_around(chunk.data, at[a:b], meet[a:b]).tobytes(), 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
        }, schema=pa.schema([("chunk", pa.string()), ("span", pa.int64()), ("runs", pa.binary()), ("bytes", pa.binary())]))

    return repeated.groupBy("chunk").applyInArrow(releasing_groups(send), "chunk string, span bigint, runs binary, bytes binary")


def _hash_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The k-gram hashes of some places, turned once more: anchors were chosen for small hashes and would crowd the first ranges."""
    out = np.empty(len(at), np.uint64)
    for low in range(0, len(at), 1 << 14):
        part = at[low:low + (1 << 14)]
        # one k-gram per row; the doubling leaves one hash for each
        rows = BYTE_HASH[data[part[:, None] + np.arange(GRAM)]]
        for n, power in enumerate(POWERS):
            rows = rows[:, :-(1 << n)] * power + rows[:, 1 << n:]
        h = rows[:, 0]
        h = (h ^ (h >> np.uint64(31))) * MIX
        out[low:low + (1 << 14)] = (h ^ (h >> np.uint64(29))) * BASE
    return out


def _around(data: np.ndarray, at: np.ndarray, meet: np.ndarray) -> np.ndarray:
    """BEFORE bytes before the anchor and LENGTH from it on, zero where no window of the run reaches."""
    off, n = meet["off"].astype(np.int64), meet["n"].astype(np.int64)
    columns = np.arange(-BEFORE, LENGTH)
    index = at[:, None] + columns
    inside = (columns >= -off[:, None]) & (columns < (n - 1 - off + LENGTH)[:, None])
    return np.where(inside, data[np.clip(index, 0, len(data) - 1)], np.uint8(0))


def beginnings(right: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row's bytes among the sorted distinct rows, and the common prefix of each of those with the one before.

    Groups with one distinct row need no sorting; the others go into a suffix array of 25-byte blocks.
    """
    distinct, where = np.unique(np.ascontiguousarray(right).view(f"V{LENGTH}").ravel(), return_inverse=True)
    own = np.zeros(len(distinct), np.int64)
    own[where] = group
    crowd = np.bincount(own, minlength=int(group.max()) + 1 if len(group) else 0)
    mixed = np.flatnonzero(crowd[own] > 1)
    rows = np.frombuffer(distinct.tobytes(), np.uint8).reshape(-1, LENGTH)
    place = np.empty(len(distinct), np.int64)
    place[crowd[own] == 1] = np.arange(len(distinct) - len(mixed))
    shared = np.zeros(len(distinct), np.int64)
    if len(mixed):
        blocks = np.ascontiguousarray(rows[mixed]).view(f"S{BLOCK}")
        _, rank = np.unique(blocks, return_inverse=True)
        per = LENGTH // BLOCK
        symbols = np.zeros((len(mixed), per + 1), np.int64)
        symbols[:, :per] = rank.reshape(-1, per) + 1
        # 0 ends every row; of all suffixes those that begin a row count
        order = np.array(suffix_array(symbols.ravel().tolist()), np.int64)
        order = mixed[order[order % (per + 1) == 0] // (per + 1)]
        base = len(distinct) - len(mixed)
        place[order] = base + np.arange(len(order))
        differs = rows[order[1:]] != rows[order[:-1]]
        prefix = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)
        shared[base + 1:] = prefix
    return place[where], shared


def equal_windows(meet: np.ndarray, around: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Which windows of each run (rows in order of their documents) also start earlier: a row of flags per run."""
    _, group = np.unique(meet["hash"], return_inverse=True)
    place, shared = beginnings(around[:, BEFORE:], group)
    again = np.zeros((len(meet), WINDOW_GRAMS), bool)
    left = np.zeros(len(meet), np.uint64)
    off, n, at = (meet[k].astype(np.int64) for k in ("off", "n", "at"))
    for offset in range(WINDOW_GRAMS):
        if offset:
            left = left * BASE + BYTE_HASH[around[:, BEFORE - offset]]
        window = off - offset
        rows = np.flatnonzero((window >= 0) & (window < n))
        if len(rows):
            # rows whose bytes agree from the anchor to the end of the window
            alike = np.cumsum(shared < LENGTH - offset)
            key = (left[rows] ^ (left[rows] >> np.uint64(29))) * MIX + alike[place[rows]].astype(np.uint64) * BASE
            firsts = np.unique(key, return_index=True)[1]
            later = np.ones(len(rows), bool)
            later[firsts] = False
            again[rows[later], (at + window)[rows[later]]] = True
    return again


def settled_runs(meeting: DataFrame) -> DataFrame:
    """(chunk, settled): the windows of each chunk's runs that also start earlier."""
    def settle(table: pa.Table) -> pa.Table:
        names = table["chunk"].to_pylist()
        parts = [np.frombuffer(b, MEETING) for b in table["runs"].to_pylist()]
        meet = np.concatenate(parts)
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        around = np.concatenate([np.frombuffer(zstandard.decompress(b), np.uint8).reshape(-1, BEFORE + LENGTH) for b in table["bytes"].to_pylist()])
        rank = np.argsort(np.argsort(np.array(names)))[of]
        order = np.lexsort((meet["anchor"], meet["ordinal"], rank, meet["doc"]))
        again = np.empty((len(meet), WINDOW_GRAMS), bool)
        again[order] = equal_windows(meet[order], around[order], rank[order])
        some = np.flatnonzero(again.any(axis=1))
        out = np.zeros(len(some), SETTLED)
        out["run"], out["bits"] = meet["run"][some], np.packbits(again[some], axis=1)
        edges = np.flatnonzero(np.concatenate([[True], np.diff(of[some]) != 0])) if len(some) else np.zeros(0, np.int64)
        bounds = [*edges.tolist(), len(some)]
        return pa.table({
            "chunk": [names[of[some[a]]] for a in edges.tolist()], "settled": [out[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
        }, schema=pa.schema([("chunk", pa.string()), ("settled", pa.binary())]))

    return meeting.groupBy("span").applyInArrow(releasing_groups(settle), "chunk string, settled binary")


def covered(chunk: Chunk, settled: list[bytes]) -> np.ndarray:
    """Which bytes of the chunk are covered by windows that also start earlier.

    Stretches of windows are marked by their ends only.
    """
    change = np.zeros(len(chunk.data) + 1, np.int32)
    np.add.at(change, chunk.runs["first"][chunk.settled], 1)
    np.add.at(change, chunk.runs["last"][chunk.settled] + LENGTH, -1)
    for blob in settled:
        rows = np.frombuffer(blob, SETTLED)
        for low in range(0, len(rows), 4096):
            part = rows[low:low + 4096]
            first = chunk.runs["first"][part["run"]]
            steps = np.diff(np.unpackbits(part["bits"], axis=1, count=WINDOW_GRAMS).astype(np.int8), axis=1, prepend=0, append=0)
            for sign, reach in ((1, 0), (-1, LENGTH - 1)):
                run, window = np.nonzero(steps == sign)
                np.add.at(change, first[run] + window + reach, sign)
    return np.cumsum(change, out=change)[:-1] > 0


def _whole_characters(data: np.ndarray, edges: np.ndarray) -> str:
    """What is left between removed stretches, without characters that lost a byte."""
    bounds = [0, *edges.tolist(), len(data)]
    return "".join(data[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(bounds[::2], bounds[1::2], strict=True))


def without_repeats(docs: DataFrame, *carry: str, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Each document with its repeated bytes removed: (carried columns, n_bytes, n_removed, n_spans, kept_sha256).

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of smaller doc_id,
    or earlier in the same one.  Ids that repeat are ordered among themselves, a null id comes first.  Null and empty
    texts have no bytes.  ``with_text`` adds what is left as ``kept``, without characters that lost a byte, and the removed
    stretches as ``spans`` (start, end); ``kept_sha256`` is of the bytes that are left.
    Carried columns may have any name; an empty table gives no rows.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    range_bits = min(40, max(6, int(np.ceil(np.log2(max(total / chunk_bytes, 1))))))
    names = [f"c{i}" for i in range(len(carry))]
    named = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)])
    chunks = write_chunks(named, names, chunk_bytes)
    found = settled_runs(meetings(repeated_runs(sent_runs(chunks, range_bits), hot_runs), range_bits))
    parts = chunks.select("chunk", F.lit(b"").alias("settled")).unionByName(found)
    results = ["n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"]
    results += ["kept string", "spans array<struct<start:bigint,end:bigint>>"] if with_text else []
    kinds = [f"{n} {named.schema[n].dataType.simpleString()}" for n in names]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(table: pa.Table) -> pa.Table:
        chunk = Chunk.read(table["chunk"][0].as_py())
        gone = covered(chunk, table["settled"].to_pylist())
        removed, spans, sha, kept, stretches = [], [], [], [], []
        for start, size in zip(chunk.starts.tolist(), chunk.sizes.tolist(), strict=True):
            own, data = gone[start:start + size], chunk.data[start:start + size]
            edges = np.flatnonzero(np.diff(own, prepend=False, append=False))
            rest = data[~own].tobytes() if len(edges) else data.tobytes()
            removed.append(size - len(rest))
            spans.append(len(edges) // 2)
            sha.append(hashlib.sha256(rest).hexdigest())
            if with_text:
                kept.append(_whole_characters(data, edges))
                stretches.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
        columns = [*chunk.rows.columns, pa.array(chunk.sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
        columns += [pa.array(kept, pa.string()), pa.array(stretches, spans_type)] if with_text else []
        return pa.table(columns, names=[*names, *(r.split()[0] for r in results)])

    done = parts.groupBy("chunk").applyInArrow(releasing_groups(finish), ", ".join([*kinds, *results]))
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], *[r.split()[0] for r in results])
