"""Outputs as one file: parts side by side, in order, plain and gzip."""

import gzip
import os

import pytest

from seqloom.sources.fastq import records, write_fastq
from seqloom.sources.onefile import shared_path, write_as_one


def frame(spark, n, parts):
    rows = spark.range(n).repartition(parts).selectExpr(
        "id AS read_idx", "concat('r', id) AS id", "repeat(substr('ACGT', 1 + int(id % 4), 1), 1 + int(id % 50)) AS sequence"
    )
    return rows.selectExpr("*", "repeat('I', length(sequence)) AS quality")


def text_of(n):
    return "".join(f"@r{i}\n{'ACGT'[i % 4] * (1 + i % 50)}\n+\n{'I' * (1 + i % 50)}\n" for i in range(n))


@pytest.mark.parametrize("packed", [False, True])
def test_parts_in_order_and_read_again(spark, tmp_path, packed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts
    try:
        for n in (3_000, 1, 0):
            path = f"{tmp_path}/a b/x{n}.fq" + (".gz" if packed else "")
            made = write_as_one(spark, lambda folder, n=n: write_fastq(frame(spark, n, 3), folder, packed), path, copy_bytes=5_000)
            assert made == path and os.path.isfile(path) and not [x for x in os.listdir(f"{tmp_path}/a b") if x.endswith((".parts", ".joining"))]
            with (gzip.open if packed else open)(path, "rt") as f:
                assert f.read() == text_of(n)
        assert records(spark, f"{tmp_path}/a b/x3000.fq" + (".gz" if packed else "")).count() == 3_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_file_is_replaced_and_a_folder_is_not(spark, tmp_path):
    (tmp_path / "x.fq").write_text("old")
    for n in (20, 10):
        write_as_one(spark, lambda folder, n=n: write_fastq(frame(spark, n, 2), folder), f"file://{tmp_path}/x.fq")
        assert (tmp_path / "x.fq").read_text() == text_of(n)
    (tmp_path / "y.fq").mkdir()
    with pytest.raises(IsADirectoryError):
        write_as_one(spark, lambda folder: write_fastq(frame(spark, 1, 1), folder), f"{tmp_path}/y.fq")
    assert not (tmp_path / "y.fq.parts").exists()


def test_other_stores_keep_the_folder(spark):
    assert shared_path(spark, "s3a://bucket/x.fq") is None and shared_path(spark, "hdfs://host/x.fq") is None
    assert shared_path(spark, "file:///a/b") == shared_path(spark, "file:/a/b") == shared_path(spark, "/a/b") == "/a/b"
    asked = []
    assert write_as_one(spark, asked.append, "s3a://bucket/x.fq") == "s3a://bucket/x.fq" and asked == ["s3a://bucket/x.fq"]
