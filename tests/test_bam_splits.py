"""BAM files read in parts: the same rows as by one task, wherever blocks and records lie."""

import random
import struct
import zlib

import pytest

from seqloom.sources import alignments as A


def block(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return A.MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flag, cigar, seq, qual, tags=b""):
    ops = b"".join(struct.pack("<I", n << 4 | A.BAM_CIGAR.index(c)) for n, c in cigar)
    codes = [A.BAM_BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    text = name.encode() + b"\0"
    data = struct.pack("<iiBBHHHiiii", 0, 5, len(text), 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + text + ops + packed + qual + tags
    return struct.pack("<i", len(data)) + data


def bam(records, wide, header=b"@HD\n"):
    data = b"BAM\x01" + struct.pack("<i", len(header)) + header + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 1000) + b"".join(records)
    draw, out, at = random.Random(wide), [], 0
    while at < len(data):
        n = draw.randint(1, wide)
        out.append(block(data[at : at + n]))
        at += n
    return b"".join(out) + block(b"")


def made(n, seed, longest=400):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        size = draw.choice([0, 1, 36, 51, longest])
        seq = "".join(draw.choices("ACGTN", k=size))
        qual = b"\xff" * size if i % 7 == 0 else bytes(draw.randint(0, 60) for _ in range(size))
        out.append((f"r{i}:{draw.randint(0, 9)}", draw.choice([0, 4, 16]), [(size, "M")] if size else [], seq, qual, bytes(draw.randint(0, 255) for _ in range(draw.choice([0, 0, 40])))))
    return [record(*r) for r in out]


def read(spark, path, split):
    return [tuple(r) for r in A.read_bam(spark, str(path), split_bytes=split).orderBy("read_idx").collect()]


@pytest.mark.parametrize("wide", [200, 3_000, 60_000])
def test_parts_equal_the_whole(spark, tmp_path, wide):
    (tmp_path / "x.bam").write_bytes(bam(made(700, wide, 5_000), wide))
    size = (tmp_path / "x.bam").stat().st_size
    want = read(spark, tmp_path / "x.bam", size + 1)
    assert len(want) == 700 and [r[1] for r in want] == list(range(700))
    for parts in (2, 7):
        split = size // parts + 1
        found = A.bam_parts(spark, [str(tmp_path / "x.bam")], split)
        assert len(found) > 1 and found[0][1] is not None
        assert read(spark, tmp_path / "x.bam", split) == want


def test_a_long_record_over_many_parts_and_a_long_header(spark, tmp_path):
    records = [*made(20, 1), *made(1, 2), record("long", 0, [], "ACGT" * 30_000, bytes(random.Random(3).randint(0, 60) for _ in range(120_000))), *made(20, 4)]
    (tmp_path / "x.bam").write_bytes(bam(records, 4_000, random.Random(5).randbytes(20_000)))
    want = read(spark, tmp_path / "x.bam", 1 << 30)
    assert len(want) == 42 and read(spark, tmp_path / "x.bam", 9_000) == want


def test_what_looks_like_records_inside_of_one_is_found_out(spark, tmp_path):
    inner = b"".join(made(40, 6))
    records = [r for i in range(30) for r in (*made(3, i), record(f"host{i}", 4, [], "ACGT", b"\x05" * 4, inner))]
    (tmp_path / "x.bam").write_bytes(bam(records, 500))
    want = read(spark, tmp_path / "x.bam", 1 << 30)
    assert len(want) == 120 and read(spark, tmp_path / "x.bam", 3_000) == want


def test_broken_files(spark, tmp_path):
    whole = bam(made(50, 8), 500)
    (tmp_path / "cut.bam").write_bytes(whole[: len(whole) * 2 // 3])
    (tmp_path / "text.bam").write_text("no BAM" * 100)
    for name in ("cut", "text"):
        with pytest.raises(Exception, match="BAM|BGZF"):
            read(spark, tmp_path / f"{name}.bam", 2_000)
    (tmp_path / "none.bam").write_bytes(bam([], 500))
    (tmp_path / "some.bam").write_bytes(whole)
    both = A.read_bam(spark, [str(tmp_path / "none.bam"), str(tmp_path / "some.bam")], split_bytes=4_000)
    assert both.count() == 50 and {r[0].rsplit("/", 1)[-1] for r in both.select("file_name").distinct().collect()} == {"some.bam"}
