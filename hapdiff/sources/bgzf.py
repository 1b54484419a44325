"""Block-gzip text files read by many tasks: a partition is a range of compressed blocks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: how a block begins (gzip, deflate, with extra fields), and its largest size.
MAGIC, LARGEST = b"\x1f\x8b\x08\x04", 1 << 16
#: Compressed bytes of a partition, and lines of a batch.
RANGE_BYTES, BATCH_LINES = 16 << 20, 1 << 14


def _open(path: str) -> pa.NativeFile:
    """A file of the machine's own disks, or of a store that pyarrow reads where path is a URI."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    store, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return store.open_input_file(at)


def block_size(head: bytes, at: int = 0) -> int | None:
    """The size of the block that begins at `at` of head, by its BC field; None where none does."""
    if head[at : at + 4] != MAGIC or len(head) < at + 12:
        return None
    end = at + 12 + struct.unpack_from("<H", head, at + 10)[0]
    at += 12
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def is_block_gzip(path: str) -> bool:
    """Whether Python can open the file and it begins with a block that tells its size. Plain gzip files don't."""
    try:
        with _open(path) as f:
            return block_size(f.read(512)) is not None
    except (OSError, ValueError, pa.ArrowException):
        return False


def inflated(raw: bytes, at: int = 0) -> bytes:
    """The text of the whole block that begins at `at` of raw."""
    size = block_size(raw, at)
    if size is None or at + size > len(raw):
        raise ValueError("no whole block")
    extra = struct.unpack_from("<H", raw, at + 10)[0]
    try:
        text = zlib.decompress(raw[at + 12 + extra : at + size - 8], -15)
    except zlib.error as e:
        raise ValueError(f"a damaged block: {e}") from e
    if struct.unpack_from("<II", raw, at + size - 8) != (zlib.crc32(text), len(text)):
        raise ValueError("a damaged block: its sum differs")
    return text


def first_block(f: pa.NativeFile, at: int, size: int) -> int:
    """Where the first block at or after `at` begins; size if none does. What only looks like a block's beginning has no text with the
    sum that it names."""
    while at < size:
        f.seek(at)
        window = f.read(2 * LARGEST + 512)
        found = window.find(MAGIC)
        while 0 <= found <= LARGEST:
            try:
                inflated(window, found)
                return at + found
            except ValueError:
                found = window.find(MAGIC, found + 1)
        at += LARGEST + 1
    return size


def _texts(f: pa.NativeFile, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(next block's place, text) of the blocks from `at` on."""
    while at < size:
        f.seek(at)
        raw = f.read(LARGEST)
        try:
            text = inflated(raw)
        except ValueError as e:
            raise ValueError(f"at byte {at}: {e}") from e
        at += block_size(raw)
        yield at, text


def range_lines(f: pa.NativeFile, start: int, end: int) -> Iterator[list[bytes]]:
    """The lines of the blocks that begin in [start, end), some at a time.

    A line belongs to the range in which the byte before it lies, the file's first line to the first range: all other ranges leave
    out what comes before their first line end, and a range reads on behind its last block up to a line's end.
    """
    size = f.size()
    at = first_block(f, start, size) if start else 0
    if at >= end:
        return
    begun, rest = start == 0, b""
    for after, text in _texts(f, at, size):  # a block that is damaged is met here, by the range before it if not by its own
        mine, at = at < end, after
        if not mine:  # only what is left of the last line
            stop = text.find(b"\n")
            if not begun:
                return  # no line begins in this range
            rest += text[: stop + 1] if stop >= 0 else text
            if stop >= 0:
                break
            continue
        if not begun:
            first = text.find(b"\n")
            if first < 0:
                continue
            begun, text = True, text[first + 1 :]
        last = text.rfind(b"\n")
        if last >= 0:
            yield (rest + text[: last + 1]).splitlines()
            rest = text[last + 1 :]
        else:
            rest += text
    if rest:
        yield rest.splitlines()


@dataclass
class _Range(InputPartition):
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[_Range]:
        with _open(self.path) as f:
            size = f.size()
        return [_Range(at, at + self.range_bytes) for at in range(0, size, self.range_bytes)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as f:
            lines: list[bytes] = []
            for some in range_lines(f, partition.start, partition.end):
                lines += some
                if len(lines) >= BATCH_LINES:
                    yield self._batch(lines)
                    lines = []
            if lines:
                yield self._batch(lines)

    @staticmethod
    def _batch(lines: list[bytes]) -> pa.RecordBatch:
        try:
            value = pa.array(lines, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            value = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
        return pa.RecordBatch.from_arrays([value], ["value"])


class BlockGzipLines(DataSource):
    """spark.read.format("block_gzip").load(path): value, a row for each line, as the text source gives them.

    Option range_bytes: compressed bytes of a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "block_gzip"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], max(1, int(self.options.get("range_bytes", RANGE_BYTES))))


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """value: the lines of a text file. A block-gzip file that Python tasks can open is read in ranges; of any other Spark's text
    source makes partitions, one where it is compressed as a whole."""
    if path.endswith((".gz", ".bgz")) and is_block_gzip(path):
        spark.dataSource.register(BlockGzipLines)
        return spark.read.format("block_gzip").option("range_bytes", str(range_bytes)).load(path)
    return spark.read.text(path)
