"""Block-compressed text in parts: the same records as by one task, wherever members, lines and parts end."""

import gzip
import random

import pytest
from test_bam_splits import block

from seqloom.sources.fastq import FastqError, records
from seqloom.sources.lines import index


def text_of(n, seed, longest=300):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        size = draw.choice([1, 20, longest])
        out.append(f"@r{i}\n{''.join(draw.choices('ACGT', k=size))}\n+\n{'@' * size}\n")
    return "".join(out)


def packed(text, wide, seed=0, lines=False):
    """Members of up to ``wide`` bytes, some empty; with ``lines`` they end where lines do."""
    draw, data, out, at = random.Random(seed), text.encode(), [], 0
    while at < len(data):
        n = draw.randint(0, wide)
        if lines:
            n = (data.find(b"\n", at + n) + 1 or len(data)) - at
        out.append(block(data[at : at + n]))
        at += n
    return b"".join(out) + block(b"")


def found(spark, path, split):
    rows = records(spark, str(path), split_bytes=split).drop("path").orderBy("read_idx").collect()
    return [tuple(r) for r in rows]


def wanted(text):
    lines = text.split("\n")
    return [(i // 4, *(x.rstrip("\r") for x in lines[i : i + 4])) for i in range(0, len(lines) - 3, 4)]


@pytest.mark.parametrize(("wide", "lines"), [(40, False), (700, False), (700, True), (1, True)])
def test_parts_equal_the_whole(spark, tmp_path, wide, lines):
    text = text_of(300, wide)
    (tmp_path / "x.fastq.gz").write_bytes(packed(text, wide, lines=lines))
    size = (tmp_path / "x.fastq.gz").stat().st_size
    for split in (size // 3, size // 11, 900):
        ix = index(spark, [str(tmp_path / "x.fastq.gz")], split)[str(tmp_path / "x.fastq.gz")]
        assert len(ix.parts) > 1 and ix.total == 1200
        assert found(spark, tmp_path / "x.fastq.gz", split) == wanted(text)


def test_long_lines_line_ends_and_no_last_line_end(spark, tmp_path):
    text = text_of(5, 1) + f"@long\r\n{'ACGT' * 4000}\r\n+\r\n{'I' * 16000}\r\n" + text_of(5, 2)[:-1]
    (tmp_path / "x.gz").write_bytes(packed(text, 50))
    assert found(spark, tmp_path / "x.gz", 700) == wanted(text)
    (tmp_path / "blank.gz").write_bytes(packed("\n" + text_of(40, 3).replace("@r7\n", "\n\n@r7\n") + "\n\n", 60))
    assert [r[1] for r in found(spark, tmp_path / "blank.gz", 500)] == [f"@r{i}" for i in range(40)]


def test_other_members_and_broken_files_are_left_to_one_task(spark, tmp_path):
    a, b = text_of(60, 4), text_of(60, 5)
    (tmp_path / "mixed.gz").write_bytes(packed(a, 300) + gzip.compress(b.encode()) + packed(a, 300))
    name = str(tmp_path / "mixed.gz")
    assert all(not ix.parts for ix in index(spark, [name], 1000).values())
    assert found(spark, tmp_path / "mixed.gz", 1000) == wanted(a + b + a)
    whole = packed(a, 300)
    (tmp_path / "cut.gz").write_bytes(whole[: len(whole) // 2 + 3])
    with pytest.raises(Exception):  # noqa: B017  Spark's reader tells what is wrong with it
        found(spark, tmp_path / "cut.gz", 1000)
    (tmp_path / "bad.gz").write_bytes(packed(a[:-30], 300))
    with pytest.raises(FastqError):
        found(spark, tmp_path / "bad.gz", 1000)
    (tmp_path / "none.gz").write_bytes(block(b"") * 100)
    assert found(spark, tmp_path / "none.gz", 1000) == []


def test_small_plain_and_split_files_together(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(packed(text_of(100, 6), 300))
    (tmp_path / "b.fastq").write_text(text_of(3, 7))
    rows = records(spark, [str(tmp_path / "a.gz"), str(tmp_path / "b.fastq")], split_bytes=2000)
    assert {(r[0].rsplit("/", 1)[-1], r[1]) for r in rows.groupBy("path").count().collect()} == {("a.gz", 100), ("b.fastq", 3)}
