"""I-Match document fingerprints with DataFrame functions only (operator 4).

Terms are white-space words in lower case, as 64-bit hashes.  The lexicon holds the terms whose document frequency lies
within a band of shares of all documents.  A fingerprint has a 32-bit hash for each of SUBSETS random subsets of the lexicon: of the
text's distinct terms in the subset, in order.  A hash of the term deals each to one subset, so that the subsets cover the
lexicon.  Two texts' likeness is the share of equal hashes among the subsets in which either has a term.

The lexicon is bounded: with P distinct (document, term) pairs in N documents at most P / (low * N) terms reach a share of
``low``, which is the mean number of distinct terms divided by ``low``, at any corpus size.  Its size is checked before it is
broadcast; a larger one is joined by shuffling.  Only a text's terms of the band are gathered, in its own map task.

Edge cases: a null text is empty; a very long one is read whole; a text without a term in the band is fingerprinted as a whole;
equal texts have equal fingerprints; rows with equal ids (ties) are ordered by text; null ids come last; the document after the last
is the first, and a lone document's next is itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

SUBSETS = 32
MOST_BROADCAST = 1_000_000
RANGE_BYTES = 64 << 20  # of texts in a range
SPACES = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.split(F.lower(text), SPACES)


def keys(text: Column) -> list[Column]:
    """Two independent hashes that stand for a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def lexicon(docs: DataFrame, path: str, low: float, high: float, text: str = "text") -> DataFrame:
    """(term, place): hashes of the terms of the band and their places in order, a table below ``path``."""
    rows = docs.select(F.explode(F.array_distinct(words(F.coalesce(F.col(text), F.lit(""))))).alias("word")).where("word <> ''")
    counts = rows.select(F.xxhash64("word").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    # places by ranges of terms: each range numbers its own, behind the sizes of those before
    band = stage(
        counts.where(
            (F.col("df") >= max(1.0, low * n)) & (F.col("df") <= max(1.0, high * n))
        ).select("term").repartitionByRange("term").withColumn("range", F.spark_partition_id()),
        f"{path}/band"
    )
    sizes = band.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("term"))
    return stage(
        band.withColumn("own", own).join(before, "range").select("term", (F.col("before") + F.col("own")).cast("int").alias("place")),
        f"{path}/lexicon"
    )


def fingerprints(texts: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, fingerprint) for each distinct text that has terms of the lexicon: SUBSETS 32-bit hashes, 0 for no term."""
    few = F.broadcast(terms) if terms.count() <= MOST_BROADCAST else terms
    k1, k2 = keys(F.col(text))
    rows = texts.select(k1.alias("k1"), k2.alias("k2"), F.explode(words(F.col(text))).alias("word")).select("k1", "k2", F.xxhash64("word").alias("term"))
    found = rows.join(few, "term").groupBy("k1", "k2").agg(F.sort_array(F.collect_set("place")).alias("own"))
    return _subsets(found, "own", "fingerprint").select("k1", "k2", "fingerprint")


def _subsets(df: DataFrame, used: str, name: str) -> DataFrame:
    """The sorted array ``used`` as the fingerprint ``name``, null where it is empty."""
    marked = df.withColumn("_used", F.transform(used, lambda t: F.struct(t.alias("t"), F.pmod(F.xxhash64(t), F.lit(SUBSETS)).alias("k"))))

    def part(k: int) -> Column:
        return F.transform(F.filter("_used", lambda t: t["k"] == k), lambda t: t["t"])

    one = lambda p: F.when(F.size(p) > 0, F.coalesce(F.nullif(F.hash(p), F.lit(0)), F.lit(1))).otherwise(F.lit(0))
    return marked.withColumn("_parts", F.array(*map(part, range(SUBSETS)))).withColumn(
        name, F.when(F.size(used) > 0, F.transform("_parts", one))
    ).drop("_parts", "_used")


def with_rest(df: DataFrame, name: str) -> DataFrame:
    """Texts without a term of the band: all hashes from the whole text's two."""
    k1, k2 = F.col(f"{name}_k1"), F.col(f"{name}_k2")
    return df.withColumn(name, F.coalesce(F.col(name), F.transform(F.sequence(F.lit(1), F.lit(SUBSETS)), lambda i: F.hash(k1, k2, i))))


def fingerprint_text(fingerprint: Column | str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.when(h == 0, "-").otherwise(F.lower(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF))))), ".")


def likeness(a: str, b: str) -> Column:
    """The share of equal hashes among the subsets that either text has terms of; 1 for equal fingerprints."""
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    some = F.size(F.filter(both, lambda p: (p["x"] != 0) | (p["y"] != 0)))
    same = F.size(F.filter(both, lambda p: (p["x"] == p["y"]) & (p["x"] != 0)))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when(some > 0, same / some).otherwise(F.lit(0.0))


def numbers(values: Iterable[int | None]) -> Column:
    """One constant of the plan, however many numbers there are; an array built value by value takes a node for each."""
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").try_cast("array<bigint>")


def range_of(doc_id: Column, limits: list[int]) -> Column:
    """How many limits are at most the id, by halving; 0 for null."""
    if not limits:
        return F.lit(0)
    of, n = numbers(limits), len(limits)
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        above = F.coalesce((s["lo"] < s["hi"]) & (doc_id >= F.get(of, mid)), F.lit(False))
        return F.struct(F.when(above, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(above | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), start, halve, lambda s: s["lo"])


def neighbours(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, text, next_id, next_text, range, place, guest): each document with the next one by descending doc_id, and the first
    after the last.

    Documents are dealt to ranges of ids, whose limits are quantiles; the largest document of a range also goes, as a guest, to
    the range above it, where it is the last one's next.  One shuffle of the texts, and no range is larger than its share."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    limits = sorted({*(ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or [])}) if n > 1 else []
    range_ = range_of(F.col("doc_id"), limits)
    rows = rows.withColumn("_range", range_)
    largest = sorted((r, -1 if m is None else m, m) for r, m in ids.groupBy(range_.alias("_range")).agg(F.max("doc_id")).collect())  # a row for each range
    host = {r: largest[(k + 1) % len(largest)][0] for k, (r, _, _) in enumerate(largest)}
    most = {r: m for r, _, m in largest}
    pick = lambda x: F.get(numbers(x.get(r) for r in range(len(limits) + 1)), F.col("_range"))
    guest = F.when(F.col("doc_id").eqNullSafe(pick(most)), F.array(F.struct(pick(host).cast("int").alias("r"), F.lit(True).alias("guest"))))
    here = F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("guest")))
    rows = rows.withColumn("_place", F.explode(F.concat(here, F.coalesce(guest, F.array().cast("array<struct<r:int,guest:boolean>>")))))
    rows = rows.select("doc_id", "text", F.col("_place.r").alias("range"), F.col("_place.guest").alias("guest"))
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    rows = rows.withColumns({"_next": F.lead(F.struct("doc_id", "text")).over(order), "place": F.row_number().over(order)})
    return rows.select("doc_id", "text", F.col("_next.doc_id").alias("next_id"), F.col("_next.text").alias("next_text"), "range", "place", "guest")


def next_documents(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """(doc_id, text, next_id, next_text) of each document; see neighbours()."""
    return neighbours(docs, partitions).where("NOT guest").drop("range", "place", "guest")


def compare(docs: DataFrame, path: str, low: float = 0.002, high: float = 0.2) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, next_id, fingerprint, edited_fingerprint, next_fingerprint): for each document and
    the same with its last third replaced by as much of the next one's beginning; fingerprints are arrays of hashes.

    Once neighbours lie in one range nothing is dealt out again: a text's words, those of its edited text and what is known of
    both are rows of the range, words out of the band go, and the rest is gathered by (range, place)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    terms = lexicon(docs, path, low, high)
    few = F.broadcast(terms) if terms.count() <= MOST_BROADCAST else terms
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    pairs = neighbours(docs, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    known = F.struct(
        "doc_id", "next_id", "guest", n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        *(
            k.alias(f"{name}_k{i + 1}") for name,
            source in (("fingerprint", "text"), ("edited_fingerprint", "edited")) for i,
            k in enumerate(keys(F.col(source)))
        )
    )
    word = lambda side, source: F.transform(F.array_distinct(words(F.col(source))), lambda w: F.struct(F.lit(side).alias("side"), F.xxhash64(w).alias("term")))
    marks = F.concat(
        F.array(F.struct(F.lit(-1).alias("side"), F.lit(None).cast("long").alias("term"))), word(0, "text"),
        F.coalesce(word(1, "edited"), F.array().cast("array<struct<side:int,term:bigint>>"))
    )
    rows = pairs.select("range", "place", known.alias("known"), F.explode(marks).alias("m"))
    rows = rows.select(
        "range", F.col("place").alias("at"), F.when(F.col("m.side") < 0, F.col("known")).alias("known"),
        F.col("m.side").alias("side"), F.col("m.term").alias("term")
    )
    rows = rows.join(few, "term", "left").where("side < 0 OR place IS NOT NULL")
    used = lambda side: F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("place"))))
    found = rows.groupBy("range", "at").agg(F.first("known", ignorenulls=True).alias("known"), used(0).alias("own"), used(1).alias("new"))
    out = found.select("range", "at", "known.*", "own", "new")
    for name, source in (("fingerprint", "own"), ("edited_fingerprint", "new")):
        out = with_rest(_subsets(out, source, name), name)
    out = out.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("range").orderBy("at"))).where("NOT guest")
    return out.select("doc_id", "n_chars", "edited_sha256", "next_id", "fingerprint", "edited_fingerprint", "next_fingerprint")
