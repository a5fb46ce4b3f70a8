"""A training-data pipeline: documents go through five stages, each written as Parquet and read again by the next.

Quality (rejected documents go), line dedup (cross-site boilerplate lines go), near-dedup (one document of each group stays),
secret scan (secrets are replaced) and packing (token sequences).  All but the last return the columns of documents.

Edge cases, the same in every stage: a null text counts as empty and stays null; very long texts are taken whole; a null doc_id
is kept (the near-dedup stage never takes such a row for a copy); repeated rows are treated alike, so that they stay or go
together; ties are decided by the smaller doc_id and the earlier line; an empty table gives no rows; columns that documents have
besides doc_id, text, lang, source and n_chars, whatever their names, are handed on until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import linededup, neardup, packing, quality, secrets
from seqloom.llm.queries import table, tokenizer_file
from seqloom.llm.shared import columns, own_name, remove, stage, work_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the additive model, trained on the labelled ones among the source's documents, rejects.

    The rejecting score is low, so that doubtful documents stay."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), label="quality", modulus=5, out=0)
    return quality.keep(docs, model, least=0.3)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that stand on three sites or more, but for their first occurrence; a document with nothing left goes."""
    lines, removed = own_name(docs, "lines_seen"), own_name(docs, "lines_removed")
    out = linededup.remove(docs, work_dir(spark, "pipeline-lines"), site="source", min_sites=3, min_chars=1, n_lines=lines, n_removed=removed)
    some = F.col(removed) > 0
    out = out.where(~(some & (F.col(removed) >= F.col(lines))))
    return out.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more on five-word shingles stays."""
    return neardup.keep_one(docs, work_dir(spark, "pipeline-copies"), k=5, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets; every document stays."""
    names = {"base": own_name(docs, "base_spans"), "spans": own_name(docs, "secret_spans")}
    found = secrets.scan(docs, secrets.train(secrets.default_samples(spark)), **names)
    some = own_name(found, "with_secrets")
    out = secrets.redact(found.withColumn(some, F.size(names["spans"]) > 0), **names)
    return out.withColumn("n_chars", F.when(F.col(some), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*columns(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row for each piece of a document, with the check sum of its ids."""
    pieces = packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=2, capacity=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("copies", drop_copies), ("secrets", hide_secrets), ("packing", pack_tokens)]

#: Learned scores and token vocabularies are beyond SQL: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    folder = work_dir(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"{folder}/{name}")
        if last:  # nothing reads the stage before any more
            remove(spark, last)
        last = f"{folder}/{name}"
    return docs
