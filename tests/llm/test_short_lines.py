from collections import defaultdict

import corpus_pipeline as P
from seqloom.llm import queries as Q

LICENCE, MENU = "All rights reserved.", "Home"
TEXTS = [
    (1, f"One text of its own\n{LICENCE}\n{MENU}\n", "a"),
    (2, f"Another text\n  {LICENCE.upper()}\n{MENU}", "b"),
    (3, f"{MENU}\nA third text\n{LICENCE}\n\n{LICENCE}", "c"),
    (4, f"Two sites only\n{LICENCE}", "a"),
    (5, "Two sites only\nx", "b"),
    (6, MENU, "d"),
]


def test_spread_decides_for_short_lines(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(
        [(i, t, "en", s, len(t)) for i, t, s in TEXTS],
        "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{folder}/documents.parquet")
    key = lambda line: line.strip(" \t\n\x0b\f\r").lower()
    sites, first = defaultdict(set), {}
    for i, t, s in TEXTS:
        for at, line in enumerate(t.split("\n")):
            sites[key(line)].add(s)
            first.setdefault(key(line), (i, at))
    want = {}
    for i, t, _ in TEXTS:
        lines = t.split("\n")
        want[i] = "\n".join(x for at, x in enumerate(lines) if not key(x) or len(sites[key(x)]) < 3 or first[key(x)] == (i, at))
    found = {r.doc_id: r for r in Q.op7_lines(spark, folder).collect()}
    assert {i: r.clean_text for i, r in found.items()} == want
    assert {i: r.n_removed for i, r in found.items()} == {1: 0, 2: 2, 3: 3, 4: 1, 5: 0, 6: 1}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert {r.doc_id: r.text for r in P.drop_lines(spark, docs, folder).collect()} == {i: t for i, t in want.items() if i != 6}
