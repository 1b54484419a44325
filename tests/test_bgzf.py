"""Block-gzip text in ranges against the same file read as a whole."""

import gzip
import io
import random
import struct
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hapdiff.sources import bgzf, records


def block(text: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(text) + deflate.flush()
    size = 12 + 6 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", size - 1) + body + struct.pack("<II", zlib.crc32(text), len(text))


def packed(text: bytes, each: int) -> bytes:
    return b"".join(block(text[i : i + each]) for i in range(0, len(text), each)) + block(b"")


def in_ranges(raw: bytes, size: int) -> list[bytes]:
    out = []
    for at in range(0, len(raw), size):
        out += [x for some in bgzf.range_lines(pa.PythonFile(io.BytesIO(raw), "r"), at, at + size) for x in some]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"", b"a", b"\r", b"bb\r", b"ccc\tx", b"d" * 90]), max_size=40), st.booleans(), st.integers(1, 60), st.integers(1, 400))
def test_each_line_is_in_one_range(lines, ended, each, size):
    text = b"\n".join(lines) + (b"\n" if ended and lines else b"")
    raw = packed(text, each)
    assert gzip.decompress(raw) == text
    assert in_ranges(raw, size) == text.splitlines()


def test_blocks_are_told_from_what_looks_like_one():
    rng = random.Random(1)
    fake = block(b"x" * 50)[:18]  # the beginning of a block, kept as it is within the next one
    text = b"\n".join(fake + rng.randbytes(300).replace(b"\n", b"") for _ in range(50))
    stored = b"".join(
        (lambda t: (lambda body: b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", 26 + len(body) - 1) + body + struct.pack("<II", zlib.crc32(t), len(t)))(
            b"\x01" + struct.pack("<HH", len(t), len(t) ^ 0xFFFF) + t))(text[i : i + 700])
        for i in range(0, len(text), 700)
    )
    assert fake in stored[30:]
    for size in (97, 500, 5000):
        assert in_ranges(stored, size) == text.splitlines()


def test_damage_is_an_error(tmp_path):
    first = len(block(b"abc\n" * 75))
    for at in (0, first - 8, first, first + 18, 2 * first - 1):  # headers, texts and sums of the first two blocks
        for size in (10_000, first, 7):
            raw = bytearray(packed(b"abc\n" * 400, 300))
            raw[at] ^= 255
            with pytest.raises(ValueError, match="block"):
                in_ranges(bytes(raw), size)
    with pytest.raises(ValueError, match="no whole block"):
        in_ranges(packed(b"abc\n" * 400, 300)[:-40], 10_000)


def sample(n: int, seed: int) -> bytes:
    rng = random.Random(seed)
    lines = []
    for k in range(n):
        at = rng.randrange(1, 50_000)
        lines.append(f"chr{1 + k % 3}\t{at}\t{at + rng.randrange(200)}\t{'01' * rng.randrange(1, 4)}\t{rng.randrange(1, 9)}\t{rng.choice('+-*')}")
    return "\n".join(lines).encode() + b"\n"


def test_one_file_by_eight_tasks(spark, tmp_path):
    text = sample(40_000, 3) + "é\r\n\r\n\nlast without an end".encode()
    path = str(tmp_path / "s.tsv.gz")
    raw = packed(text, 5000)
    with open(path, "wb") as f:
        f.write(raw)
    whole = spark.read.text(path)
    assert whole.rdd.getNumPartitions() == 1
    got = bgzf.read_lines(spark, path, range_bytes=-(-len(raw) // 8))
    assert got.rdd.getNumPartitions() == 8
    assert [r.value for r in got.collect()] == [r.value for r in whole.collect()] == text.decode().splitlines()
    assert sum(1 for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n) == 8


def test_samples_of_all_kinds(spark, tmp_path):
    """Plain, gzip and block-gzip files of the same records are the same samples."""
    text = sample(3000, 5)
    names = {"plain": "a.tsv", "whole": "b.tsv.gz", "ranges": "c.tsv.gz", "suffix": "d.tsv.bgz"}
    for kind, name in names.items():
        (tmp_path / name).write_bytes(text if kind == "plain" else gzip.compress(text) if kind == "whole" else packed(text, 700))
    assert [bgzf.is_block_gzip(str(tmp_path / n)) for n in names.values()] == [False, False, True, True]
    assert not bgzf.is_block_gzip(str(tmp_path / "missing.gz")) and bgzf.is_block_gzip(f"file://{tmp_path}/c.tsv.gz")
    own = records.read_records(spark, {k: str(tmp_path / n) for k, n in names.items()})
    assert "block_gzip" in own._jdf.queryExecution().toString()
    by = {}
    for r in own.collect():
        by.setdefault(r.sample, []).append(tuple(r)[1:])
    assert len(by) == 4 and all(sorted(v) == sorted(by["plain"]) and len(v) == 3000 for v in by.values())


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.gz").write_bytes(block(b""))
    assert bgzf.read_lines(spark, str(tmp_path / "e.gz")).count() == 0
