"""PLY point clouds and meshes, read by byte ranges.

Headers are read in tasks first, once per load.  A body of fixed records, and an ASCII body, is
then cut into ranges that any task can read alone.  Of a large body with list properties
on its vertices each byte range is searched for the vertices it holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capturemill.session import checkpointed, small_side
from capturemill.sources.chains import Reader, Step, record_ranges
from capturemill.sources.mesh_text import mesh_from_path
from capturemill.sources.ranges import FileCursor, in_batches, read_range
from capturemill.sources.text_lines import numbered_lines

# Scalar types and the 13-byte triangle record.
SCALARS = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4",
    "float64": "f8",
}
TRIANGLE = np.dtype([("count", "u1"), ("v", "<i4", 3)])
CHANNELS = (("red", "r"), ("green", "g"), ("blue", "b"))
RANGE_BYTES = 64 << 20

HEADER = "path string, size bigint, kind string, start bigint, nv bigint, nf bigint, props string, problem string"
VERTEX = "path string, vertex_id bigint, x float, y float, z float, r smallint, g smallint, b smallint, views array<bigint>, problem string"
FACE = "path string, face_id bigint, v0 bigint, v1 bigint, v2 bigint, problem string"


# --- headers -----------------------------------------------------------------------------------

def read_header(path: str) -> dict:
    """Format, body start, counts and vertex properties of one file."""
    cursor = FileCursor(path)
    kind, element, counts, props, at = None, None, {"vertex": 0, "face": 0}, [], 0
    try:
        while True:
            raw = cursor.until(b"\n")
            at += len(raw) + 1
            words = raw.decode("utf-8", errors="ignore").split()
            if not raw and not cursor.left:
                raise ValueError("no end_header")
            if words == ["end_header"]:
                break
            if words[:1] == ["format"]:
                kind = words[1]
            elif words[:1] == ["element"]:
                element = words[1]
                if element in counts:
                    counts[element] = int(words[2])
            elif words[:1] == ["property"] and element == "vertex":
                props.append(words[1:])
    finally:
        cursor.close()
    if kind == "binary_big_endian":
        raise ValueError("big-endian bodies are not supported")
    if kind not in ("ascii", "binary_little_endian"):
        raise ValueError(f"unknown format {kind}")
    lists = [p[0] == "list" for p in props]
    if kind != "ascii" and any(lists):
        if not all(lists[lists.index(True):]):
            raise ValueError("scalar properties after a list property are not supported")
        kind = "listed"
    return {"kind": "fixed" if kind == "binary_little_endian" else kind, "start": at, "nv": counts["vertex"],
            "nf": counts["face"], "props": json.dumps(props)}


def ply_headers(spark: SparkSession, path: str, strict: bool = True, pattern: str = "*.ply") -> DataFrame:
    """One row per PLY file; unreadable headers raise, or tell a problem when not strict."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, size in zip(batch["path"], batch["length"]):
                try:
                    rows.append({"path": file, "size": size, **read_header(file), "problem": None})
                except Exception as problem:  # noqa: BLE001 - told or raised
                    if strict:
                        raise ValueError(f"{file}: {problem}") from problem
                    rows.append({"path": file, "size": size, "kind": None, "start": 0, "nv": 0, "nf": 0, "props": "[]",
                                 "problem": str(problem)})
            yield pd.DataFrame(rows)

    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(path).select("path", "length").repartition(spark.sparkContext.defaultParallelism)
    )
    return files.mapInPandas(read, HEADER)


def _record(props: list[list[str]]) -> np.dtype:
    """Record of the scalar vertex properties, in file order."""
    return np.dtype([(p[1], "<" + SCALARS[p[0]]) for p in props if p[0] != "list"])


def _channel(names: tuple[str, ...], pair: tuple[str, str]) -> str | None:
    return next((n for n in pair if n in names), None)


def _vertex_frame(path: str, first: int, data: np.ndarray, views=None, partial_colors: bool = False) -> pd.DataFrame:
    names = data.dtype.names or ()
    channels = [_channel(names, pair) for pair in CHANNELS]
    if not partial_colors and None in channels:
        channels = [None] * 3
    out = {"path": path, "vertex_id": np.arange(first, first + len(data), dtype=np.int64)}
    for axis in "xyz":
        if axis in names:
            out[axis] = data[axis].astype(np.float32)
        elif partial_colors:
            out[axis] = np.zeros(len(data), dtype=np.float32)
        else:
            raise ValueError(f"vertices have no {axis}")
    for column, channel in zip("rgb", channels):
        # cast through uint8 as colours are bytes
        out[column] = np.full(len(data), 255, np.int16) if channel is None else data[channel].astype(np.uint8).astype(np.int16)
    out["views"] = [None] * len(data) if views is None else views
    out["problem"] = None
    return pd.DataFrame(out)


def _problem(path: str, columns: str, text: str) -> pd.DataFrame:
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    return pd.DataFrame([{n: None for n in names} | {"path": path, "problem": text}], dtype=object)


# --- plans over byte ranges --------------------------------------------------------------------

def _record_ranges(headers: DataFrame, count: Column, begin: Column, stride: Column) -> DataFrame:
    """Rows (path, props, first, rows, at): ranges of whole records."""
    per = F.greatest(F.floor(F.lit(RANGE_BYTES) / stride), F.lit(1)).cast("long")
    firsts = headers.where(count > 0).select(
        "path", "props", count.alias("count"), begin.alias("begin"), stride.alias("stride"), per.alias("per"),
        F.explode(F.sequence(F.lit(0).cast("long"), count - 1, per)).alias("first"),
    )
    return firsts.select(
        "path", "props", "first", F.least("per", F.col("count") - F.col("first")).alias("rows"),
        (F.col("begin") + F.col("first") * F.col("stride")).alias("at"),
    )


def _spread(rows: DataFrame) -> DataFrame:
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def _stride(headers: DataFrame) -> Column:
    sizes = F.create_map(*[F.lit(v) for name, code in SCALARS.items() for v in (name, int(code[1]))])
    props = F.from_json("props", "array<array<string>>")
    return F.aggregate(props, F.lit(0).cast("long"), lambda total, p: total + sizes[p[0]].cast("long"))


def _ascii_ranges(headers: DataFrame) -> DataFrame:
    """Byte ranges of ASCII bodies with the number of line ends before each."""
    body = F.col("size") - F.col("start")
    ranges = headers.where((F.col("kind") == "ascii") & (body > 0)).select(
        "path", "start", "nv", "nf", "size",
        F.explode(F.sequence(F.col("start"), F.col("size") - 1, F.lit(RANGE_BYTES).cast("long"))).alias("at"),
    ).withColumn("length", F.least(F.lit(RANGE_BYTES).cast("long"), F.col("size") - F.col("at"))).drop("size")
    schema = "path string, start bigint, nv bigint, nf bigint, at bigint, length bigint, ends bigint"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = [read_range(*r).count(b"\n") for r in zip(batch["path"], batch["at"], batch["length"])]
            yield batch.assign(ends=ends)

    counted = _spread(ranges).mapInPandas(count, schema)
    earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("ends").over(earlier), F.lit(0).cast("long")))


def _lines_of(path: str, start: int, at: int, length: int, before: int) -> Iterator[tuple[int, list[str]]]:
    """Numbered lines that begin inside one range."""
    end = at + length
    cursor, index, place = FileCursor(path, at if at == start else at - 1), before, at
    try:
        if at != start:
            # the byte before the range tells whether a line begins at its edge
            skipped = cursor.until(b"\n")
            place = at - 1 + len(skipped) + 1
            index = before if not skipped else before + 1
        while place < end:
            raw = cursor.until(b"\n")
            yield index, raw.decode("utf-8", errors="ignore").split()
            place, index = place + len(raw) + 1, index + 1
    finally:
        cursor.close()


def _ascii_rows(headers: DataFrame, columns: str, row_of: Callable) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                try:
                    found = (row for i, words in _lines_of(r.path, r.start, r.at, r.length, r.before)
                             if (row := row_of(r, i, words)) is not None)
                    for rows in in_batches(found):
                        names = [c.strip().split(" ")[0] for c in columns.split(",")]
                        yield pd.DataFrame([(r.path, *row, None) for row in rows], columns=names)
                except ValueError as problem:
                    yield _problem(r.path, columns, str(problem))

    return _spread(_ascii_ranges(headers)).mapInPandas(read, columns)


# --- vertices ----------------------------------------------------------------------------------

def _ascii_vertex(r, i: int, words: list[str]):
    if i >= r.nv or len(words) < 3:
        return None
    color = [int(w) for w in words[3:6]] if len(words) >= 6 else [255, 255, 255]
    return (i, *[float(w) for w in words[:3]], *color, None)


def _fixed_vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            record = _record(json.loads(r.props))
            step = max(1, (8 << 20) // record.itemsize)
            for done in range(0, r.rows, step):
                rows = min(step, r.rows - done)
                raw = read_range(r.path, r.at + done * record.itemsize, rows * record.itemsize)
                yield _vertex_frame(r.path, r.first + done, np.frombuffer(raw, dtype=record))


def _lists(props: list[list[str]]) -> list[tuple[np.dtype, np.dtype]]:
    return [(np.dtype("<" + SCALARS[p[1]]), np.dtype("<" + SCALARS[p[2]])) for p in props if p[0] == "list"]


def _after_vertex(props: str) -> Step:
    """Step over one vertex with list properties."""
    listed = json.loads(props)
    scalars = _record(listed).itemsize
    lists = [(count.itemsize, count.kind == "i", item.itemsize) for count, item in _lists(listed)]

    def step(reader: Reader, place: int) -> int | None:
        at = place + scalars
        for size, signed, item in lists:
            raw = reader.take(at, size)
            n = int.from_bytes(raw, "little", signed=signed)
            at += size + n * item
            if len(raw) < size or n < 0 or at > reader.size:
                return None
        return at if at <= reader.size else None

    return step


SPANS = "part string, path string, props string, first bigint, rows bigint, at bigint, problem string"


def listed_spans(headers: DataFrame) -> DataFrame:
    """Ranges (path, props, first, rows, at) of bodies with list properties; faces follow as one span.

    A body that ends early has one row that tells the problem.
    """
    split = RANGE_BYTES

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The span of faces behind the last range of vertices of each file."""
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                reader, step = Reader(r.path), _after_vertex(r.props)
                place, left = r.at, r.rows
                while left and place is not None:
                    place, left = step(reader, place), left - 1
                reader.close()
                short = "vertex body ends early" if place is None else None
                rows.append(("face", r.path, r.props, 0, r.nf, place or 0, short))
            yield pd.DataFrame(rows, columns=["part", "path", "props", "first", "rows", "at", "problem"])

    listed = headers.where(F.col("kind") == "listed")
    if not listed.limit(1).count():
        return headers.sparkSession.createDataFrame([], SPANS)
    large = (F.col("size") - F.col("start") > split) & (F.col("nv") > 0)
    whole = listed.select("path", "props", "nf", F.lit(0).cast("long").alias("first"), F.col("nv").alias("rows"), F.col("start").alias("at"))
    spans = whole.join(listed.where(~large).select("path"), "path", "left_semi")
    if listed.where(large).limit(1).count():
        files = checkpointed(listed.where(large).select("path", "size", "start", F.col("nv").alias("count"), F.col("props").alias("layout")))
        cut = record_ranges(files, _after_vertex, split)
        earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of a file
        cut = cut.withColumn("first", F.coalesce(F.sum("records").over(earlier), F.lit(0).cast("long")))
        spans = spans.unionByName(cut.select("path", "first", F.col("records").alias("rows"), "at").join(listed.select("path", "props", "nf"), "path"))
    spans = checkpointed(spans)
    last = spans.groupBy("path").agg(F.max_by(F.struct("props", "nf", "rows", "at"), "at").alias("s")).select("path", "s.*")
    faces = checkpointed(_spread(last).mapInPandas(ends, SPANS))
    bad = faces.where(F.col("problem").isNotNull())
    vertices = spans.join(bad.select("path"), "path", "left_anti").select(
        F.lit("vertex").alias("part"), "path", "props", "first", "rows", "at", F.lit(None).cast("string").alias("problem"))
    told = bad.select(F.lit("vertex").alias("part"), "path", "props", *[F.lit(0).cast("long").alias(c) for c in ("first", "rows", "at")], "problem")
    return vertices.unionByName(faces.where(F.col("problem").isNull())).unionByName(told)


def _listed_vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.problem:
                yield _problem(r.path, VERTEX, r.problem)
                continue
            props, first = json.loads(r.props), r.first
            record, lists = _record(props), _lists(props)
            cursor = FileCursor(r.path, r.at)

            def vertex() -> tuple[bytes, list[int]]:
                scalars, views = cursor.exactly(record.itemsize), []
                for count_type, item_type in lists:
                    n = int(np.frombuffer(cursor.exactly(count_type.itemsize), count_type)[0])
                    views += np.frombuffer(cursor.exactly(n * item_type.itemsize), item_type).astype(np.int64).tolist()
                return scalars, views

            for rows in in_batches(vertex() for _ in range(r.rows)):
                data = np.frombuffer(b"".join(s for s, _ in rows), dtype=record)
                yield _vertex_frame(r.path, first, data, [views for _, views in rows], True)
                first += len(rows)
            cursor.close()


def ply_vertices(headers: DataFrame, mesh: Callable[[Column], Column] = mesh_from_path, spans: DataFrame | None = None) -> DataFrame:
    """Vertices of the files in a header table.

    Colours default to 255.  ASCII rows of under three fields are skipped; the others
    keep their declared number.  A short fixed body gives a problem row only.
    """
    stride = _stride(headers)
    fixed = headers.where(F.col("kind") == "fixed").withColumn("__stride", stride)
    whole = F.col("size") >= F.col("start") + F.col("nv") * F.col("__stride")
    ranges = _record_ranges(fixed.where(whole), F.col("nv"), F.col("start"), F.col("__stride"))
    short = fixed.where(~whole).select("path", F.lit("vertex body is too short").alias("problem"))
    told = headers.where(F.col("problem").isNotNull()).select("path", "problem").unionByName(short)
    listed = (listed_spans(headers) if spans is None else spans).where(F.col("part") == "vertex")
    rows = (
        _spread(ranges).mapInPandas(_fixed_vertices, VERTEX)
        .unionByName(_ascii_rows(headers, VERTEX, _ascii_vertex))
        .unionByName(_spread(listed).mapInPandas(_listed_vertices, VERTEX))
        .unionByName(told, allowMissingColumns=True)
    )
    return rows.withColumn("mesh_id", mesh(F.col("path")))


# --- faces -------------------------------------------------------------------------------------

def _ascii_face(r, i: int, words: list[str]):
    if not r.nv <= i < r.nv + r.nf or len(words) < 4 or int(words[0]) != 3:
        return None
    return (i - r.nv, *[int(w) for w in words[1:4]])


def _face_frame(path: str, first: int, raw: bytes) -> pd.DataFrame:
    v = np.frombuffer(raw, dtype=TRIANGLE)["v"].astype(np.int64)
    return pd.DataFrame({
        "path": path, "face_id": np.arange(first, first + len(v), dtype=np.int64),
        "v0": v[:, 0], "v1": v[:, 1], "v2": v[:, 2], "problem": None,
    })


def _fixed_faces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    step = (8 << 20) // TRIANGLE.itemsize
    for batch in batches:
        for r in batch.itertuples(index=False):
            for done in range(0, r.rows, step):
                rows = min(step, r.rows - done)
                raw = read_range(r.path, r.at + done * TRIANGLE.itemsize, rows * TRIANGLE.itemsize)
                yield _face_frame(r.path, r.first + done, raw)


def ply_faces(headers: DataFrame, mesh: Callable[[Column], Column] = mesh_from_path, spans: DataFrame | None = None) -> DataFrame:
    """Triangles of the files in a header table.

    Binary faces are taken as 13-byte triangles, and none is given when the body is
    shorter than that; ASCII faces of other sizes are left out.
    """
    fixed = headers.where(F.col("kind") == "fixed").withColumn("__at", F.col("start") + F.col("nv") * _stride(headers))
    behind = (listed_spans(headers) if spans is None else spans).where((F.col("part") == "face") & (F.col("rows") > 0))
    listed = behind.join(headers.select("path", "size", "nf"), "path").withColumn("__at", F.col("at"))
    body = [d.select("path", "props", "size", "nf", "__at") for d in (fixed, listed)]
    whole = body[0].unionByName(body[1]).where(F.col("size") >= F.col("__at") + F.col("nf") * TRIANGLE.itemsize)
    ranges = _record_ranges(whole, F.col("nf"), F.col("__at"), F.lit(TRIANGLE.itemsize).cast("long"))
    rows = _spread(ranges).mapInPandas(_fixed_faces, FACE).unionByName(_ascii_rows(headers, FACE, _ascii_face))
    return rows.withColumn("mesh_id", mesh(F.col("path")))


def load_ply(
    spark: SparkSession, path: str, mesh: Callable[[Column], Column] = mesh_from_path, strict: bool = True,
    pattern: str = "*.ply",
) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of all PLY files below a folder."""
    headers = checkpointed(ply_headers(spark, path, strict, pattern))
    spans = listed_spans(headers)
    return ply_vertices(headers, mesh, spans), ply_faces(headers, mesh, spans)


def load_ply_text(
    spark: SparkSession, path: str, mesh: Callable[[Column], Column] = mesh_from_path, pattern: str = "*.ply", parts: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of ASCII files, split on the JVM; with ``parts`` the ordered text parts of a folder are one file.

    Lines are numbered by any number of tasks, so neither a large file nor an export by many tasks is read as a
    whole.  Rows are those of :func:`load_ply`: colours default to 255, vertex rows of under three fields and
    faces of other sizes than three are skipped, the others keep their declared number.
    """
    lines = numbered_lines(spark, path, pattern, parts).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", ""))
    ends = lines.where(F.col("line") == "end_header").groupBy("path").agg(F.min("seq").alias("head"))
    ends = small_side(ends)

    def count(element: str) -> Column:
        return F.coalesce(F.max(F.regexp_extract("line", rf"^element {element} (\d+)$", 1).try_cast("long")), F.lit(0))

    heads = small_side(lines.join(ends, "path").where("seq <= head").groupBy("path", "head").agg(
        count("vertex").alias("nv"), count("face").alias("nf")))
    body = lines.join(heads, "path").where("seq > head").select(
        "path", (F.col("seq") - F.col("head") - 1).alias("i"), "nv", "nf", F.split("line", r"\s+").alias("words"))

    def word(n: int, kind: str) -> Column:
        return F.col("words")[n - 1].cast(kind)

    colored = F.size("words") >= 6
    vertices = body.where((F.col("i") < F.col("nv")) & (F.size("words") >= 3)).select(
        "path", F.col("i").alias("vertex_id"), *[word(n, "float").alias(a) for n, a in enumerate("xyz", 1)],
        *[F.when(colored, word(n, "smallint")).otherwise(F.lit(255).cast("smallint")).alias(c) for n, c in enumerate("rgb", 4)],
    )
    faces = body.where((F.col("i") >= F.col("nv")) & (F.col("i") < F.col("nv") + F.col("nf")) & (F.size("words") >= 4) & (F.col("words")[0] == "3"))
    faces = faces.select("path", (F.col("i") - F.col("nv")).alias("face_id"), *[word(n + 2, "long").alias(f"v{n}") for n in range(3)])
    return vertices.withColumn("mesh_id", mesh(F.col("path"))), faces.withColumn("mesh_id", mesh(F.col("path")))
