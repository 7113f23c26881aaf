"""Fill-in-middle transformation by repeated captures.

One full match of ``(unit)*`` keeps every repetition of its group, so ``ends(1)`` holds the ends of all units of a text:
their number and both cut offsets are read from it, and no unit is visited in Python.  Which documents are rearranged,
in which form and where they are cut follows from a hash of seed and id alone, so any task and any rerun agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturemill.llm.common import releasing, slices

# A unit is a word with the white space before it, or white space at the end of the text.
BLANK = r"\x20\x09-\x0D"
UNITS = regex.compile(rf"([{BLANK}]*+[^{BLANK}]++|[{BLANK}]++)*+")
WORD_END = regex.compile(rf"(?<=[^{BLANK}])(?=[{BLANK}])")
# Code points a match spans; the matcher keeps about 250 bytes per capture and gives up at a gigabyte.
PIECE = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SLICE_BYTES = 4 << 20

COLUMNS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def unit_ends(text: str) -> np.ndarray:
    """Ends of all units of a text, in code points.

    A text longer than ``PIECE`` is matched piece by piece; pieces end where a unit does, so the units are the same.
    """
    ends, at = [], 0
    while at < len(text):
        to = len(text)
        if to - at > PIECE and (cut := WORD_END.search(text, at + PIECE)):
            to = cut.start()
        ends.append(np.array(UNITS.fullmatch(text, at, to).ends(1), np.int64))
        at = to
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document; a null id counts as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def rearranged(doc_id: int | None, text: str, seed: int, percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    low, high = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm_percent:
        return n, SPM, low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Every row of (doc_id, text) with its fill-in-middle form: (doc_id, n, form, prefix_chars, middle_chars, output).

    ``percent`` of the documents are rearranged, ``spm_percent`` of these suffix first; the others, and texts that are
    empty or hold a marker already, stay plain.  A null text is empty, a null id draws as empty text would, rows that
    repeat an id are drawn alike and all stay.  A text of white space is one unit.  Texts may be of any length.  Other
    columns are not looked at.
    """
    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (len(t.as_buffer()) if t.is_valid else 0 for t in batch["text"])
            for low, high in slices(sizes, SLICE_BYTES):
                ids = batch["doc_id"].slice(low, high - low)
                texts = batch["text"].slice(low, high - low)
                rows = [rearranged(i, t or "", seed, percent, spm_percent) for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                    pa.array(output, pa.string()),
                ], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(transform), COLUMNS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; a text with markers is plain, so an output has each marker once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == PSM, F.concat(part(1), part(3), part(2))).when(form == SPM, F.concat(part(2), part(3), part(1))).otherwise(output)
