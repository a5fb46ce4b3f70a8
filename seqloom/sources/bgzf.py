"""BGZF: gzip in small members that tell their sizes, so that a file can be read in parts.

It is what BAM is kept in, and text that a block compressor wrote (``.gz`` by name, too)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs

MAGIC = b"\x1f\x8b\x08\x04"  # Fixed value: how a BGZF block begins
SPLIT_BYTES = 32 << 20
BATCH_BYTES, BATCH_LINES = 8 << 20, 65_536


def opened(path: str):
    """A file for reading from any place, and its size."""
    local = path[5:] if path.startswith("file:") else path
    fs, place = (pafs.LocalFileSystem(), "/" + local.lstrip("/")) if local.startswith("/") else pafs.FileSystem.from_uri(path)
    return fs.open_input_file(place), fs.get_file_info(place).size


class Blocks:
    """BGZF: gzip members whose extra field gives their size, decompressed one after the other; a place in it is where a member
    begins and how far into its bytes."""

    def __init__(self, file, size: int, begin: int = 0):
        self.file, self.size, self.next = file, size, begin
        self.block, self.data, self.at = begin, b"", 0

    def header(self, at: int) -> tuple[int, int] | None:
        """The sizes of a member and of its head, if one begins here."""
        self.file.seek(at)
        head = self.file.read(12)
        if len(head) < 12 or head[:4] != MAGIC:
            return None
        extra = struct.unpack("<H", head[10:12])[0]
        fields, k = self.file.read(extra), 0
        while k + 4 <= len(fields):
            name, n = fields[k : k + 2], struct.unpack("<H", fields[k + 2 : k + 4])[0]
            if name == b"BC" and n == 2:
                return struct.unpack("<H", fields[k + 4 : k + 6])[0] + 1, 12 + extra
            k += 4 + n
        return None

    def load(self) -> bool:
        """The next member; false at the end."""
        if self.next >= self.size:
            return False
        found = self.header(self.next)
        if found is None:
            raise ValueError("not BGZF")
        whole, head = found
        body = self.file.read(whole - head)
        if len(body) < whole - head:
            raise EOFError("BGZF ends within a block")
        data = zlib.decompress(body[:-8], -15)
        if zlib.crc32(data) != struct.unpack("<I", body[-8:-4])[0]:
            raise zlib.error("BGZF: a block's check sum is wrong")
        self.block, self.data, self.at = self.next, data, 0
        self.next += whole
        return True

    def place(self) -> tuple[int, int]:
        while self.at >= len(self.data):
            if not self.load():
                return self.size, 0
        return self.block, self.at

    def take(self, n: int) -> bytes:
        if len(self.data) - self.at >= n:
            self.at += n
            return self.data[self.at - n : self.at]
        parts = []
        while n:
            if self.at >= len(self.data) and not self.load():
                raise EOFError("BAM ends within a record")
            parts.append(self.data[self.at : self.at + n])
            self.at += len(parts[-1])
            n -= len(parts[-1])
        return b"".join(parts)

    def find(self, begin: int) -> bool:
        """Go to the first member that begins at ``begin`` or later; false if there is none.  What looks like one must be followed
        by another (or the end) and decompress."""
        window, at = b"", begin
        while at < self.size:
            self.file.seek(at)
            window = self.file.read(1 << 17)
            k = window.find(MAGIC)
            while k >= 0:
                if found := self.header(at + k):
                    after = at + k + found[0]
                    try:
                        if after == self.size or after < self.size and self.header(after):
                            self.next, self.data, self.at = at + k, b"", 0
                            return self.load()
                    except zlib.error:
                        pass
                k = window.find(MAGIC, k + 1)
            if len(window) < 1 << 17:
                return False
            at += len(window) - 3
        return False


def large(path: str, split_bytes: int) -> int | None:
    """The size of a file that begins as BGZF and is larger than a part; else None."""
    try:
        file, size = opened(path)
    except (OSError, pa.ArrowException):  # a folder, a pattern, or no file: left to Spark
        return None
    with file:
        return size if size is not None and size > split_bytes and Blocks(file, size).header(0) else None


class Part:
    """The lines of a file's part: those that begin behind its first byte up to the first byte behind it, which is its first member
    that begins in it (or the next one).  So each line belongs to one part, whichever members it lies in."""

    def __init__(self, path: str, begin: int, until: int, member: int | None = None):
        self.path, self.begin, self.until, self.member = path, begin, until, member
        self.first, self.last = None, None  # its first member, and the one behind its last

    def _chunks(self, s: Blocks) -> Iterator[bytes]:
        """The bytes of its own members, without those of a line that began before, and of one more line's end."""
        inside = self.begin == 0
        while True:
            data = s.data
            if not inside:
                at = data.find(b"\n")
                inside, data = at >= 0, data[at + 1 :] if at >= 0 else b""
            if data:
                yield data
            if s.next >= min(self.until, s.size):
                break
            s.load()
        self.last = s.next
        while inside and s.load():  # the line that begins here, or began before
            at = s.data.find(b"\n")
            if at >= 0:
                yield s.data[: at + 1]
                return
            yield s.data

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(path, block, line) in order, in batches of some megabytes; lines end in \\n or \\r\\n."""
        file, size = opened(self.path)
        with file:
            s = Blocks(file, size, self.member or 0)
            if not (s.find(self.begin) if self.member is None else s.load()) or s.block >= self.until:
                return
            self.first = s.block
            parts, held = [], 0
            for data in self._chunks(s):
                parts.append(data)
                held += len(data)
                if held > BATCH_BYTES and b"\n" in data:
                    whole, _, rest = b"".join(parts).rpartition(b"\n")
                    yield from self._rows(whole.split(b"\n"))
                    parts, held = [rest], len(rest)
            if last := b"".join(parts):
                yield from self._rows(last.removesuffix(b"\n").split(b"\n"))

    def _rows(self, lines: list[bytes]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(lines), BATCH_LINES):
            some = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines[at : at + BATCH_LINES]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.path] * len(some), pa.string()), pa.array([self.begin] * len(some), pa.int64()), pa.array(some, pa.string())],
                ["path", "block", "line"]
            )
