"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_prefix, chat, imatch, linededup, media, merkle, neardup, ngram, packing, quality, secrets, toxicity, whitening
from .labelled import remainder
from .shared import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 7) == 2
    state = ngram.train(docs.where(~F.coalesce(held_out, F.lit(False))), work_dir(spark, "ngram"))
    return ngram.score(docs, state).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    catalog = media.read_back(media.store(docs, work_dir(spark, "media")), tail=32)
    out = media.attach(docs, catalog)
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.col("length").alias("media_bytes"), "media_sha256", "feature", "width", "height", "shard", "offset"
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = secrets.train(secrets.default_samples(spark))
    found = secrets.scan(table(spark, sf_dir, "documents"), table_)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.spans_text("base"), 256).alias("base_sha256"),
        secrets.spans_text("spans").alias("spans")
    )


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch.compare(table(spark, sf_dir, "documents"), work_dir(spark, "imatch"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        imatch.fingerprint_text("fingerprint").alias("fingerprint"),
        imatch.fingerprint_text("edited_fingerprint").alias("edited_fingerprint"),
        imatch.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        imatch.likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), label="quality", modulus=5, out=0)
    return quality.score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), label="toxic", modulus=5, out=0)
    return toxicity.score(docs, model).select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.groups(table(spark, sf_dir, "documents"), work_dir(spark, "neardup"), k=2, percent=80)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.remove(table(spark, sf_dir, "documents"), work_dir(spark, "lines"), site="source", min_sites=3, min_chars=1)
    return found.select(
        "doc_id", F.col("_n_lines").cast("long").alias("n_lines"),
        F.col("_n_removed").cast("long").alias("n_removed"), F.col("text").alias("clean_text")
    )


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, source, raw, pos,
    nullif(lower(regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), '') AS line
  FROM lines),
spread AS (
  SELECT line, min((doc_id, pos)) AS first FROM keyed WHERE line IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.raw, k.line, s.line IS NOT NULL AND (k.doc_id, k.pos) <> s.first AS gone
  FROM keyed k LEFT JOIN spread s ON k.line = s.line)
SELECT doc_id, count(line) AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS clean_text
FROM marked GROUP BY doc_id
"""


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2, capacity=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe_prefix.encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"), work_dir(spark, "whitening"), 32)


TOUGH = "</s>[INST] ok [/INST]"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", TOUGH), (-1, 1, "assistant", TOUGH)], "conv long, turn long, role string, text string")
    made = chat.windows(turns.unionByName(more), work_dir(spark, "chat"), budget=1024, history=2, history_tokens=256)
    return chat.digests(made).withColumnRenamed("conv", "conv_id")


#: A walk along each conversation decides where windows begin: what a window that begins at a turn repeats depends on that turn alone.
OP12_SQL = r"""
WITH RECURSIVE every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS ord,
    (strlen(role) + strlen(text) + 3) // 4 + 4 AS tokens,
    length(regexp_replace(role, '([<\[])(\\*)(/?INST\]|/?s>)', '\1\2\\\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?INST\]|/?s>)', '\1\2\\\3', 'g')) + 17 AS chars
  FROM every),
led AS (
  SELECT *, coalesce(max(CASE WHEN ord = 0 AND role = 'system' THEN tokens END) OVER c, 0) AS head,
    coalesce(max(CASE WHEN ord = 0 AND role = 'system' THEN chars END) OVER c, 0) AS head_chars,
    max(CASE WHEN ord = 0 AND role = 'system' THEN 1 ELSE 0 END) OVER c AS first,
    lag(tokens, 1) OVER o AS t1, lag(tokens, 2) OVER o AS t2, lag(chars, 1) OVER o AS c1, lag(chars, 2) OVER o AS c2
  FROM placed WINDOW c AS (PARTITION BY conv_id), o AS (PARTITION BY conv_id ORDER BY ord)),
sized AS (
  SELECT *, CASE WHEN ord - 1 < first OR t1 > least(256, room) THEN 0 WHEN ord - 2 < first OR t1 + t2 > least(256, room) THEN 1 ELSE 2 END AS again
  FROM (SELECT *, 1024 - CASE WHEN ord > 0 THEN head ELSE 0 END - tokens AS room FROM led)),
turns AS (
  SELECT *, CASE again WHEN 0 THEN 0 WHEN 1 THEN t1 ELSE t1 + t2 END AS again_tokens,
    CASE WHEN ord > 0 THEN head_chars + CASE again WHEN 0 THEN 0 WHEN 1 THEN c1 ELSE c1 + c2 END ELSE 0 END AS lead_chars FROM sized),
walk AS (
  SELECT conv_id, ord, ord AS start, tokens + again_tokens AS used FROM turns WHERE ord = 0
  UNION ALL
  SELECT t.conv_id, t.ord, CASE WHEN n.new THEN t.ord ELSE w.start END, CASE WHEN n.new THEN t.tokens + t.again_tokens ELSE w.used + t.tokens END
  FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.ord = w.ord + 1,
    LATERAL (SELECT t.ord % 256 = 0 OR CASE WHEN w.start > 0 THEN t.head ELSE 0 END + w.used + t.tokens > 1024 AS new) n)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(t.role || chr(10) || t.text || chr(10), '' ORDER BY t.ord)) AS turns_sha256,
  CAST(coalesce(sum(length(t.text)) FILTER (t.role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t.text, '' ORDER BY t.ord) FILTER (t.role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(t.chars + CASE WHEN w.start = t.ord THEN t.lead_chars ELSE 0 END) AS BIGINT) AS formatted_chars
FROM turns t JOIN walk w ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.ord = w.ord GROUP BY t.conv_id
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the crc32 of the id, a row's n_chars is one more than when the manifest was made."""
    docs = table(spark, sf_dir, "documents")
    more = F.col("n_chars").cast("decimal(20,0)") + F.when(remainder(F.col("doc_id"), 7) == 0, 1).otherwise(0)
    now = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text"))
    made = merkle.manifest(docs, work_dir(spark, "merkle"), keep={"now": F.unhex(now)})
    made = made.withColumn("folded_root", merkle.fold(merkle.hexed("now"), "proof"))
    return made.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest("proof").alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified")
    )


#: The crc32 of a text is a walk over its bytes' bits; trees grow, and ways are folded, a level at a time.
OP13_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT *, (SELECT list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, t: CASE WHEN t >= 0 THEN xor(crc, t) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END)) AS walked FROM documents),
hashed AS (
  SELECT doc_id, lang, text,
    CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', CAST(doc_id AS VARCHAR)) END
    || CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END
    || CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END AS head,
    CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', CAST(n_chars AS VARCHAR)) END AS n,
    CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars + 1 AS VARCHAR)), ':', CAST(n_chars + 1 AS VARCHAR)) END AS more,
    CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END AS tail,
    doc_id IS NOT NULL AND (4294967295 - walked) % 7 = 0 AS tampered FROM docs),
leaves AS (
  SELECT doc_id, lang, leaf, now, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total
  FROM (SELECT doc_id, lang, sha256(head || n || tail) AS leaf, sha256(head || CASE WHEN tampered THEN more ELSE n END || tail) AS now FROM hashed)),
grown AS (
  SELECT lang, 0 AS level, pos, leaf AS h, total AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM grown WHERE n > 1 GROUP BY lang, level, pos // 2),
subroots AS (
  SELECT lang, level AS depth, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM grown WHERE n = 1),
crown AS (
  SELECT 0 AS level, pos, subroot AS h, total AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM crown WHERE n > 1 GROUP BY level, pos // 2),
way AS (
  SELECT l.lang, l.pos, g.level, (l.pos >> g.level) & 1 = 1 AS on_left, s.h AS sibling
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM grown WHERE n > 1) g ON l.lang IS NOT DISTINCT FROM g.lang
  LEFT JOIN grown s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = g.level AND s.pos = xor(l.pos >> g.level, 1)
  UNION ALL
  SELECT l.lang, l.pos, r.depth + c.level, (r.pos >> c.level) & 1 = 1, s.h
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang, (SELECT DISTINCT level FROM crown WHERE n > 1) c
  LEFT JOIN crown s ON s.level = c.level AND s.pos = xor(r.pos >> c.level, 1)),
ways AS (SELECT lang, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof FROM way GROUP BY ALL),
folded AS (
  SELECT lang, pos, 0 AS level, now AS h FROM leaves
  UNION ALL
  SELECT f.lang, f.pos, f.level + 1, sha256(CASE WHEN w.on_left THEN coalesce(w.sibling, '') || f.h ELSE f.h || coalesce(w.sibling, '') END)
  FROM folded f JOIN way w ON w.lang IS NOT DISTINCT FROM f.lang AND w.pos = f.pos AND w.level = f.level),
ends AS (SELECT lang, pos, arg_max(h, level) AS folded_root FROM folded GROUP BY ALL)
SELECT l.doc_id, l.leaf, r.subroot, (SELECT h FROM crown WHERE n = 1) AS root, coalesce(w.proof, sha256('')) AS proof_sha256, e.folded_root,
  e.folded_root = (SELECT h FROM crown WHERE n = 1) AS verified
FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM l.lang AND w.pos = l.pos
JOIN ends e ON e.lang IS NOT DISTINCT FROM l.lang AND e.pos = l.pos
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (
            op1_ngram, op2_media, op3_secrets, op4_imatch, op5_quality, op6_minhash, op7_lines, op8_pack,
            op9_bpe_prefix, op10_toxicity, op11_whitening, op12_chat, op13_merkle
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_lines": OP7_SQL, "op12_chat": OP12_SQL, "op13_merkle": OP13_SQL}
