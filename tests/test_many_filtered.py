"""More filtered reads than travel to the tasks: keys are counted by the reads' places all the same."""

import random

from pyspark.sql import functions as F

from seqloom import queries as Q
from seqloom.config import QcConfig
from seqloom.operators import fused, sequences
from seqloom.schema import READS


def test_query_beyond_the_skips(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, sequences.duplication(Q.many(spark, sf_dir), Q.CFG).select("label", Q.six("percent"), Q.six("deduplicated")).collect()))
    monkeypatch.setattr(fused, "SKIPS_MOST", 10)
    assert sorted(map(tuple, Q.duplication_beyond_cap(spark, sf_dir).collect())) == want


def test_early_keys_equal_key_counts(spark):
    draw = random.Random(5)
    pool = ["".join(draw.choices("ACGT", k=40)) for _ in range(600)]
    rows = [(name, i, "r", draw.choice(pool), "I" * 40, None, draw.random() < 0.3) for name, n in (("a", 9_000), ("b", 1_500)) for i in range(n)]
    rows += [("c", 0, "r", "ACGT", "IIII", None, True)]  # a file all of whose reads are filtered
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, READS).repartition(3)
    for cap in (20, 400, 10_000):
        config = QcConfig(unique_cap=cap)
        columns = ["file_name", "key", *(F.col(c).cast("long") for c in ("n", "first", "rank", "total"))]
        got, want = (sorted(map(tuple, k.select(*columns).collect())) for k in (sequences.early_key_counts(df, config), sequences.key_counts(df, config)))
        assert got == want and got
