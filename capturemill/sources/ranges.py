"""Reading parts of files inside tasks, on any file system Arrow can reach."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

from pyarrow import fs

READ_BLOCK = 8 << 20
# Files of variable-length records above this size are cut into ranges of about this size.
SPLIT_BYTES = 64 << 20


class FileCursor:
    """Buffered forward reader over one file, holding a few blocks at most."""

    def __init__(self, path: str, offset: int = 0):
        system, inner = file_system(path)
        self._file = system.open_input_file(inner)
        self._size = self._file.size()
        self._at = offset
        self._buffer, self._used = b"", 0

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer only at the end of the file."""
        while len(self._buffer) - self._used < n and self._at < self._size:
            block = self._file.read_at(max(READ_BLOCK, n), self._at)
            self._at += len(block)
            self._buffer, self._used = self._buffer[self._used:] + block, 0
        out = self._buffer[self._used:self._used + n]
        self._used += len(out)
        return out

    def exactly(self, n: int) -> bytes:
        out = self.take(n)
        if len(out) < n:
            raise EOFError(f"file ends {n - len(out)} bytes early")
        return out

    def skip(self, n: int) -> None:
        """Move on without keeping what is passed; may run past the end."""
        held = len(self._buffer) - self._used
        if n <= held:
            self._used += n
        else:
            self._buffer, self._used = b"", 0
            self._at += n - held

    def until(self, mark: bytes) -> bytes:
        """Bytes up to a one-byte mark, which is consumed; all that is left if it never comes."""
        out = []
        while True:
            end = self._buffer.find(mark, self._used)
            if end >= 0:
                out.append(self._buffer[self._used:end])
                self._used = end + 1
                break
            out.append(self._buffer[self._used:])
            self._buffer, self._used = b"", 0
            if self._at >= self._size:
                break
            self._buffer = self._file.read_at(READ_BLOCK, self._at)
            self._at += len(self._buffer)
        return b"".join(out)

    @property
    def position(self) -> int:
        return self._at - len(self._buffer) + self._used

    @property
    def left(self) -> int:
        return self._size - self.position

    def close(self) -> None:
        self._file.close()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow file system and inner path of a Hadoop-style path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(path[5:]).replace("///", "/", 1)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def read_range(path: str, offset: int, length: int) -> bytes:
    system, inner = file_system(path)
    with system.open_input_file(inner) as file:
        return file.read_at(length, offset)


def in_batches(rows: Iterator[tuple], size: int = 20_000) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
