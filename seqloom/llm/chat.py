"""Conversations as training windows of a token budget, with DataFrame functions only (operator 12).

Turns of a conversation are ordered by ranges (dealt out by (conversation, turn), sorted, and numbered as they lie; a conversation
that goes on in the next range is carried on by a sum over ranges), and walked in blocks of BLOCK turns, so that no task has a
whole long conversation.  Along a block, prefix sums of the turns' tokens choose spans of whole turns: a window takes turns while
the budget holds, and one more begins where it doesn't.  Each window but the first begins with the conversation's system turn
and repeats up to ``history`` turns before its own, as far as ``history_tokens`` and the budget allow.  The loss mask has the
texts of the assistant's own turns of a window, not of repeated ones, so that each is learned from once.

A turn is written as HEAD role SAYS text END.  In roles and texts a control string gets one backslash more behind its first
character, be it one as it is or one with backslashes already: that is undone by taking one away, so any text comes back.

Edge cases: a null text or role is empty; a null conversation id is a conversation of its own; turns of the same number come by
role, then by the text's md5, and equal rows are turns of their own; a null turn number comes first; a turn longer than the
budget is a window of its own with whatever system turn there is (never cut); a conversation of a system turn alone is a window;
an empty table has no windows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

HEAD, SAYS, END = "[INST]", "[/INST]", "</s>"
CONTROL = r"(/?INST\]|/?s>)"  # what follows the first character of a control string: also <s>, which this template leaves alone
SYSTEM, ASSISTANT = "system", "assistant"
BLOCK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"([<\[])(\\*)" + CONTROL), F.lit(r"$1$2\\$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"([<\[])(\\*)\\" + CONTROL), F.lit(r"$1$2$3"))


def byte_tokens(role: Column, text: Column) -> Column:
    """A turn's tokens, estimated: four bytes are one, and marks are four."""
    return F.floor((F.octet_length(role) + F.octet_length(text) + 3) / 4).cast("long") + 4


def ordered(turns: DataFrame, path: str, tokens: Callable[[Column, Column], Column]) -> DataFrame:
    """(conv, ord, total, role, text, tokens): the turns' places from 0 in their conversations."""
    keys = ["conv", "turn", "role", "_digest", "_alike"]  # equal rows may be parted, too
    dealt = turns.withColumns({"_digest": F.md5("text"), "_alike": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = stage(dealt.select("conv", "role", "text", tokens(F.col("role"), F.col("text")).alias("tokens"), F.monotonically_increasing_id().alias("_row")), path)
    dealt = dealt.withColumn("_range", F.shiftright("_row", 33))
    first = dealt.groupBy("_range", "conv").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    of = Window.partitionBy("conv")  # a row a range
    before = F.coalesce(F.sum("_n").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select(F.col("_range").alias("_r"), F.col("conv").alias("_c"), "_first", before.alias("_before"), F.sum("_n").over(of).alias("total"))
    out = dealt.join(first, (F.col("_range") == F.col("_r")) & F.col("conv").eqNullSafe(F.col("_c")))
    return out.select("conv", (F.col("_before") + F.col("_row") - F.col("_first")).alias("ord"), "total", "role", "text", "tokens")


def blocks(turns: DataFrame, history: int) -> DataFrame:
    """(conv, block, system, turns): a block's own turns behind up to ``history`` turns before them, and the system turn."""
    own = F.floor(F.col("ord") / BLOCK)
    last = F.floor((F.col("total") - 1) / BLOCK)
    lead = (F.col("ord") == 0) & (F.col("role") == SYSTEM)
    # a turn stands in its own block, and in the next one if that may repeat it; the system turn in all
    to = F.when(lead, last).when((F.col("ord") % BLOCK >= BLOCK - history) & (own < last), own + 1).otherwise(own)
    rows = turns.select("conv", F.struct("ord", "role", "text", "tokens").alias("t"), lead.alias("lead"), own.alias("own"), F.explode(F.sequence(own, to)).alias("block"))
    return rows.groupBy("conv", "block").agg(
        F.max(F.when(F.col("lead"), F.col("t"))).alias("system"), F.array_sort(F.collect_list(F.when(~F.col("lead") | (F.col("block") == F.col("own")), F.col("t")))).alias("turns")
    )


def _repeats(turns: Column, i: Column, room: Column, history: int, history_tokens: int, before: Column) -> Column:
    """(n, tokens): how many turns before place ``i`` a window that begins there repeats; turns before ``before`` don't count."""
    out = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("tokens"))
    size = F.lit(0).cast("long")
    fits = F.lit(True)
    for n in range(1, history + 1):
        t = F.get(turns, i - n)
        size = size + t["tokens"]
        fits = fits & F.coalesce((i >= n) & (t["ord"] >= before) & (size <= history_tokens) & (size <= room), F.lit(False))
        out = F.when(fits, F.struct(F.lit(n).alias("n"), size.alias("tokens"))).otherwise(out)
    return out


def windows(turns: DataFrame, path: str, budget: int = 1024, history: int = 2, history_tokens: int = 256, tokens: Callable[[Column, Column], Column] = byte_tokens) -> DataFrame:
    """(conv, window, repeated, text, loss, n_tokens): ``window`` is the place of its first own turn; ``repeated`` tells how many
    turns at its beginning are the system turn and history; ``loss`` has (start, end) in code points of the text.

    ``turns`` has conv, turn, role and text."""
    clean = turns.select("conv", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = blocks(ordered(clean, path, tokens), history)
    system = F.coalesce(F.col("system")["tokens"], F.lit(0).cast("long"))
    before = F.when(F.col("system").isNotNull(), 1).otherwise(0)  # the first turn that may be repeated
    sizes = F.transform(
        "turns", lambda t, i: F.struct(
            t["ord"].alias("ord"), t["tokens"].alias("tokens"),
            _repeats(F.col("turns"), i, F.lit(budget) - F.when(t["ord"] > 0, system).otherwise(0) - t["tokens"], history, history_tokens, before).alias("again")
        )
    )
    rows = rows.withColumn("sizes", sizes)

    def step(a: Column, i: Column) -> Column:
        s = F.get(F.col("sizes"), i)
        upto = a["upto"] + s["tokens"]  # the prefix sum at the turn's end
        own = s["ord"] >= F.col("block") * BLOCK
        head = F.when(a["ord"] > 0, system).otherwise(0)
        begins = own & ((F.size(a["starts"]) == 0) | (head + upto - a["base"] > budget))
        start = F.struct(i.alias("at"), s["again"]["n"].alias("n"))
        return F.struct(
            upto.alias("upto"), F.when(begins, a["upto"] - s["again"]["tokens"]).otherwise(a["base"]).alias("base"),
            F.when(begins, s["ord"]).otherwise(a["ord"]).alias("ord"),
            F.when(begins, F.concat(a["starts"], F.array(start))).otherwise(a["starts"]).alias("starts")
        )

    zero = F.lit(0).cast("long")
    none = F.struct(zero.alias("upto"), zero.alias("base"), zero.alias("ord"), F.array().cast("array<struct<at:int,n:int>>").alias("starts"))
    walk = F.aggregate(F.sequence(F.lit(0), F.size("turns") - 1), none, step, lambda a: a["starts"])
    rows = rows.withColumn("starts", walk)
    ends = F.transform("starts", lambda s, k: F.struct(s["at"].alias("at"), s["n"].alias("n"), F.coalesce(F.get(F.col("starts"), k + 1)["at"], F.size("turns")).alias("end")))
    cut = F.transform(
        ends, lambda s: F.struct(
            F.get(F.col("turns"), s["at"])["ord"].alias("window"),
            F.slice("turns", s["at"] - s["n"] + 1, s["n"]).alias("again"), F.slice("turns", s["at"] + 1, s["end"] - s["at"]).alias("own")
        )
    )
    rows = rows.select("conv", "system", F.explode(cut).alias("w")).select("conv", "w.window", "w.own", F.when(F.col("w.window") > 0, F.array_compact(F.concat(F.array("system"), "w.again"))).otherwise(F.array_compact(F.array(F.lit(None).cast(_turn(turns))))).alias("again"))
    written = rows.withColumns({"again_text": _write("again"), "pieces": F.transform("own", lambda t: F.struct(t["role"].alias("role"), escape(t["role"]).alias("as"), escape(t["text"]).alias("says")))})
    start = F.struct(F.length("again_text").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def mask(a: Column, p: Column) -> Column:
        begin = a["at"] + F.length(p["as"]) + len(HEAD) + len(SAYS)
        end = begin + F.length(p["says"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct((end + len(END)).alias("at"), F.when(p["role"] == ASSISTANT, F.concat(a["loss"], F.array(span))).otherwise(a["loss"]).alias("loss"))

    body = F.array_join(F.transform("pieces", lambda p: F.concat(F.lit(HEAD), p["as"], F.lit(SAYS), p["says"], F.lit(END))), "")
    total = F.aggregate(F.concat("again", "own"), zero, lambda a, t: a + t["tokens"])
    return written.select(
        "conv", "window", F.size("again").alias("repeated"), F.concat("again_text", body).alias("text"),
        F.aggregate("pieces", start, mask, lambda a: a["loss"]).alias("loss"), total.alias("n_tokens")
    )


def _turn(turns: DataFrame) -> str:
    return "struct<ord:bigint,role:string,text:string,tokens:bigint>"


def _write(turns: str) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), escape(t["role"]), F.lit(SAYS), escape(t["text"]), F.lit(END))), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv, window, turns, learned) from the windows' texts and masks alone: each window's own turns (role, text), and the
    texts under its mask."""
    parts = F.split("text", r"\Q" + END + r"\E", -1)  # the last one is empty
    own = F.slice(parts, F.col("repeated") + 1, F.size(parts) - 1 - F.col("repeated"))

    def turn(part: Column) -> Column:
        two = F.split(part, r"\Q" + SAYS + r"\E", 2)
        return F.struct(unescape(F.substring(F.get(two, 0), F.lit(len(HEAD) + 1), F.length(part))).alias("role"), unescape(F.get(two, 1)).alias("text"))

    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv", "window", F.transform(own, turn).alias("turns"), learned.alias("learned"), F.length("text").alias("chars"))


def digests(formatted: DataFrame, group: int = 64) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the windows.  A digest is of one
    string, so a conversation's texts meet at last; they are put together in two steps, some windows first."""
    read = read_back(formatted).select(
        "conv", "window", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("learned", "").alias("learned"), F.col("chars").cast("long").alias("chars")
    )

    def join(rows: DataFrame, *by: str) -> DataFrame:
        all_ = F.array_sort(F.collect_list(F.struct("window", "said", "learned")))
        text = lambda name: F.array_join(F.transform("all", lambda x: x[name]), "").alias(name)
        return rows.groupBy(*by).agg(all_.alias("all"), F.sum("n").alias("n"), F.sum("chars").alias("chars")).select(
            *by, F.get("all", F.lit(0))["window"].alias("window"), "n", text("said"), text("learned"), "chars"
        )

    out = join(join(read.withColumn("_part", F.floor(F.col("window") / (BLOCK * group))), "conv", "_part"), "conv")
    return out.select(
        "conv", F.col("n").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.col("chars").cast("long").alias("formatted_chars")
    )
