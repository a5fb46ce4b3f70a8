"""Many candidates in one text, and how well the ratio tells real identifiers from random strings."""

import importlib
import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from seqloom.llm import secrets


@pytest.fixture(scope="module")
def table(spark):
    return secrets.train(secrets.default_samples(spark))


def hexes(n, seed=1):
    draw = random.Random(seed)
    return "\n".join("".join(draw.choices("0123456789abcdef", k=64)) for _ in range(n))


def test_a_megabyte_of_hex_in_one_text(spark, table):
    took = {}
    for n in (1, 2_000, 16_000):
        df = spark.createDataFrame([(1, hexes(n))], "doc_id long, text string")
        began = time.perf_counter()
        row = secrets.redact(secrets.scan(df, table).withColumn("n", F.size("spans"))).first()
        took[n] = time.perf_counter() - began
        assert row.n == n and row.text == "\n".join([secrets.REPLACEMENT] * n)
    assert took[2_000] < 2 * took[1] + 6 and took[16_000] < took[1] + 40, took


def test_labelled_identifiers_and_tokens(spark, table):
    """Names of the standard library against random tokens: neither is in the samples that the models are made from."""
    names = set()
    for module in ("asyncio", "unittest", "logging", "email", "http.client", "socket", "ssl", "os", "typing", "ast", "inspect", "tkinter", "ctypes", "decimal", "unittest.mock", "importlib", "concurrent.futures", "multiprocessing", "xml.dom", "sqlite3", "urllib.request"):
        try:
            own = importlib.import_module(module)
        except ImportError:
            continue
        for name in dir(own):
            names.update([name, *dir(getattr(own, name, None))])
    ordinary = sorted(n for n in names if re.fullmatch(secrets.CANDIDATE, n))
    draw = random.Random(3)
    alphabets = [string.ascii_letters + string.digits, string.hexdigits.lower()[:16], string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits]
    tokens = ["".join(draw.choices(alphabets[i % 4], k=draw.randint(24, 48))) for i in range(400)]
    assert len(ordinary) > 150
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ordinary, *tokens])], "doc_id long, text string")
    found = {r.doc_id for r in secrets.scan(df, table).where(F.size("spans") > 0).select("doc_id").collect()}
    right = sum(i in found for i in range(len(ordinary), len(ordinary) + len(tokens)))
    wrong = sum(i in found for i in range(len(ordinary)))
    print(len(ordinary), right, wrong)
    assert right >= 0.95 * len(tokens) and wrong <= 0.02 * len(ordinary)
