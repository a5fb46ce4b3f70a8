"""Queries against their SQL, also where rows, ids and texts are missing or repeat."""

import duckdb
import pytest

from seqloom.llm import queries

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def compare(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'' if '/testdata/' in str(folder) else '/*.parquet'}')")
    df = queries.queries()[name](spark, str(folder))
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(str(r) for r in found.fetchall())
    assert sorted(str(tuple(r[n] for n in names)) for r in df.collect()) == theirs and theirs


@pytest.mark.parametrize(("name", "table"), [("op12_chat", "conversations"), ("op13_merkle", "documents"), ("op7_lines", "documents")])
def test_on_the_small_tables(spark, sf_dir, name, table):
    compare(spark, sf_dir, name, [table])


def test_odd_conversations(spark, tmp_path):
    rows = [(1, t, ("user", "assistant")[t % 2], f"[INST] {t} </s>" * (t % 40)) for t in range(300)] + [(2, 0, "system", "x" * 900), (2, 1, "user", "y" * 4_000), (2, 2, "assistant", "é\\</s>")]
    rows += [(None, 0, None, None), (None, None, "assistant", "a"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", None)]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    compare(spark, tmp_path, "op12_chat", ["conversations"])


def test_odd_documents(spark, tmp_path):
    rows = [(i - 5, f"t{i}" * (i % 3), [None, "", "a", "é"][i % 4], None if i % 7 == 0 else "s", None if i % 5 == 0 else i) for i in range(45)]
    rows += [(1, None, "a", None, None), (1, None, "a", None, None), (None, "x", "only", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, tmp_path, "op13_merkle", ["documents"])
