"""Operator 13 against a manifest built in one loop."""

import hashlib
import zlib
from itertools import groupby

import pytest

from seqloom.llm import merkle, queries
from seqloom.llm.shared import work_dir

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))


def tree(digests):
    """Root, and the ways of all leaves: (is the sibling on the right, sibling)."""
    ways, at = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        new, held = [], []
        for i in range(0, len(digests), 2):
            pair = digests[i : i + 2]
            for k in range(len(pair)):
                for j in at[i + k]:
                    ways[j].append((k == 0, pair[1 - k] if len(pair) == 2 else ""))
            new.append(h(*pair))
            held.append([j for k in range(len(pair)) for j in at[i + k]])
        digests, at = new, held
    return digests[0], ways


def fold(d, way):
    for right, s in way:
        d = h(d, s) if right else h(s, d)
    return d


def expected(rows):
    lang = lambda r: (r[2] is not None, (r[2] or "").encode())
    rows = sorted(rows, key=lambda r: (lang(r), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [[*g] for _, g in groupby(rows, key=lang)]
    built = [tree([leaf(r) for r in g]) for g in groups]
    root, tops = tree([b[0] for b in built])
    out = []
    for g, (sub, ways), top in zip(groups, built, tops, strict=True):
        for r, way in zip(g, ways, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            new = fold(leaf((*r[:4], r[4] + 1)) if tampered else leaf(r), way + top)
            out.append((r[0], leaf(r), sub, root, h(*(s for _, s in way + top)), new, new == root))
    return out


def run(spark, rows, tmp_path, kind=KIND):
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.op13_merkle(spark, str(tmp_path)).collect()]


def by(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[4]))


@pytest.mark.parametrize("bits", [2, 10])
def test_equals_a_loop(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    monkeypatch.setattr(merkle, "FEW", 40 if bits == 2 else 100_000)  # joins by shuffle, too
    rows = [(i * 7 % 311, f"text {i} é" * (i % 5), [None, "", "de", "en", "fr"][i % 5 if i % 3 else 3], None if i % 11 == 0 else f"s{i % 4}", None if i % 13 == 0 else i) for i in range(311)]
    found = run(spark, rows, tmp_path)
    assert by(found) == by(expected(rows))
    assert sum(not r[-1] for r in found) > 20


def test_edges(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "", None, "", 0), (5, "a\n" * 60_000, "xx", "s", 3), (5, "b", "xx", "s", 3), (5, "b", "xx", "s", 3), (9, "one", "alone", "s", 2**63 - 1)]
    found = run(spark, rows, tmp_path)
    assert by(found) == by(expected(rows))
    wide = spark.createDataFrame([(*r, 1, 2) for r in rows], KIND + ", pos int, digest int")
    again = merkle.manifest(wide, work_dir(spark, "merkle")).select("doc_id", "leaf", "root").collect()
    assert {tuple(r) for r in again} == {(r[0], r[1], r[3]) for r in found}
    assert merkle.manifest(spark.createDataFrame([], KIND), work_dir(spark, "merkle")).collect() == []


def test_one_row_and_many_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "FEW", 200)  # more groups than are broadcast
    rows = [(i, "t", f"lang{i % 23}", "s", i) for i in range(70)]
    assert by(run(spark, rows, tmp_path / "a")) == by(expected(rows))
    assert by(run(spark, rows[:1], tmp_path / "b")) == by(expected(rows[:1]))
