"""Operator 12 against windows chosen in a loop, and its template on texts made of control strings."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from seqloom.llm import chat, queries
from seqloom.llm.shared import work_dir

KIND = "conv long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def tokens(role, text):
    return (len(role.encode()) + len(text.encode()) + 3) // 4 + 4


def expected(turns, budget, history, history_tokens):
    """[(first own turn, repeated turns, own turns)] of one conversation."""
    turns = sorted(((t, r or "", s or "") for t, r, s in turns), key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
    turns = [(r, s) for _, r, s in turns]
    first = 1 if turns[0][0] == "system" else 0
    size = [tokens(*t) for t in turns]
    out, used = [], 0
    for i in range(len(turns)):
        head = size[0] if first and i else 0
        if not out or i % chat.BLOCK == 0 or used + size[i] > budget:
            again = []
            for j in range(i - 1, max(i - 1 - history, first - 1), -1):
                total = sum(size[k] for k in [*again, j])
                if total > history_tokens or head + total + size[i] > budget:
                    break
                again.insert(0, j)
            out.append((i, ([0] if head else []) + again, [i]))
            used = head + sum(size[k] for k in again) + size[i]
        else:
            out[-1][2].append(i)
            used += size[i]
    return turns, out


def compare(spark, rows, **limits):
    made = chat.windows(spark.createDataFrame(rows, KIND), work_dir(spark, "chat"), **limits)
    found, back = made.collect(), {(r.conv, r.window): r for r in chat.read_back(made).collect()}
    digests = {r.conv: r for r in chat.digests(made).collect()}
    ids = {r[0] for r in rows}
    assert set(digests) == ids
    for c in ids:
        turns, want = expected([r[1:] for r in rows if r[0] == c], **limits)
        own = sorted((r for r in found if r.conv == c), key=lambda r: r.window)
        assert [(r.window, r.repeated) for r in own] == [(w, len(again)) for w, again, _ in want]
        for r, (w, again, body) in zip(own, want, strict=True):
            read = back[c, w]
            assert [tuple(t) for t in read.turns] == [turns[i] for i in body]
            assert read.learned == [turns[i][1] for i in body if turns[i][0] == "assistant"]
            assert r.n_tokens == sum(tokens(*turns[i]) for i in [*again, *body])
            assert r.n_tokens <= limits["budget"] or len(body) == 1
        d, learned = digests[c], "".join(t for r, t in turns if r == "assistant")
        assert (d.n_turns, d.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (d.loss_chars, d.loss_sha256) == (len(learned), sha(learned))
        assert d.formatted_chars == sum(len(r.text) for r in own)


LIMITS = {"budget": 120, "history": 2, "history_tokens": 60}


def test_equals_a_loop(spark):
    draw = random.Random(5)
    roles = ["user", "assistant"]
    rows = []
    for c in range(40):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind " * draw.randint(0, 5)))
        rows += [(c, 1 + t, roles[t % 2], "wörd " * int(draw.expovariate(0.05))) for t in range(draw.randint(1, 30))]
    compare(spark, rows, **LIMITS)


def test_long_conversation_and_edges(spark):
    rows = [(1, 0, "system", "s")] + [(1, t, "user" if t % 2 else "assistant", f"{t} x") for t in range(1, 700)]
    rows += [(2, 0, "user", "same")] * 600  # equal rows of one turn
    rows += [(None, 0, None, None), (None, None, "assistant", "first"), (3, 0, "system", "alone"), (4, 0, "assistant", "y" * 300_000), (5, 1, "user", ""), (5, 0, "user", "system?")]
    compare(spark, rows, **LIMITS)
    assert chat.windows(spark.createDataFrame([], KIND), work_dir(spark, "chat")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_any_text_comes_back(spark, seed):
    draw = random.Random(seed)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "</s>", "[INST]", "[/INST]", "<s>", "a", "\n", "$1", "é", "\\s>", "<\\/s>"]
    rows = [(c, t, draw.choice(["user", "assistant", "to[/INST]ol\n", ""]), "".join(draw.choices(parts, k=draw.randint(0, 12)))) for c in range(30) for t in range(6)]
    compare(spark, rows, **LIMITS)
    df = spark.createDataFrame(rows, KIND).select("text", chat.escape(F.col("text")).alias("e"))
    assert df.where((chat.unescape(F.col("e")) != F.col("text")) | F.contains("e", F.lit("</s>")) | F.contains("e", F.lit("INST]")) & F.col("e").rlike(r"\[/?INST\]")).count() == 0


def test_query_takes_extra_columns(spark, tmp_path):
    spark.createDataFrame([(7, 0, "user", "hi", 1, 2), (7, 1, "assistant", "there", 1, 2)], "conv_id long, turn long, role string, text string, conv int, window int").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r.conv_id: r for r in queries.op12_chat(spark, str(tmp_path)).collect()}
    assert set(rows) == {7, -1} and rows[-1].loss_chars == len(queries.TOUGH) and rows[-1].loss_sha256 == sha(queries.TOUGH)
