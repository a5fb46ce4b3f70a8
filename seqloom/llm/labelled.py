"""Bounded, deterministic samples of labelled documents, and the folds that keep some rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo a number."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, out: int, max_rows: int, by_class: bool = False) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the fold ``out``, at most ``max_rows`` (for each label if
    ``by_class``): those whose ids hash lowest, so that a run repeats.  Rows without id or label don't count; of rows with the
    same id, one (with the least text) does."""
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder(F.col("doc_id"), modulus) != out)
    )
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    if by_class:
        picked = rows.where("label = 0").orderBy(*order).limit(max_rows).unionAll(rows.where("label = 1").orderBy(*order).limit(max_rows))
    else:
        picked = rows.orderBy(*order).limit(max_rows)
    # at most 2 * max_rows rows of 12 bytes: a proven bound
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
