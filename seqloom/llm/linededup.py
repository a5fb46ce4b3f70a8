"""Line dedup by distinct-site spread with DataFrame functions only (operator 7).

A line (trimmed, in lower case) is known by a 64-bit hash.  A HyperLogLog sketch for each line, merged by aggregation, estimates
on how many sites it stands; lines whose estimate is within the sketch's error of the threshold get an exact distinct count.
Lines that reach ``min_sites`` sites are boilerplate: of each only its first occurrence, by (document, place), stays.  Lines of
fewer than ``min_chars`` characters (none, unless asked for) stay where they are.

Frequent lines are met in salted form, so that no task gets all rows of one line; each map task hands on one sketch a line.

Edge cases: blank lines are no lines; a null text stays null and has none; a null site counts nowhere; a null doc_id is the last;
repeated rows are one document (both keep the first occurrence); very long texts are split like others, and equal lines of one
document count once for its site; of equal first places (ties) all stay; an empty table gives no rows; other columns are kept,
whatever their names, but for those named like the two new ones (_n_lines and _n_removed, unless others are asked for).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import own_name, stage

SALTS = 16
LG_K = 9
ERRORS = 4  # standard errors that count as near


def line_array(text: Column | str) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column, min_chars: int) -> Column:
    """A hash of what is left of a line in lower case without white space around it; null for a shorter one."""
    own = F.lower(F.btrim(line, F.lit(" \t\n\x0b\f\r")))
    return F.when(F.length(own) >= max(1, min_chars), F.xxhash64(own))


def occurrences(docs: DataFrame, site: str, min_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_doc, _site, _at, _line): all lines that are long enough."""
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(site).alias("_site"), F.posexplode(line_array(text)).alias("_at", "_raw"))
    return rows.select("_doc", "_site", "_at", line_key(F.col("_raw"), min_chars).alias("_line")).where("_line IS NOT NULL")


def boilerplate(lines: DataFrame, path: str, min_sites: int) -> DataFrame:
    """(_line, _first): lines on at least ``min_sites`` sites, and where they stand first."""
    first = F.min(F.struct(F.coalesce(F.col("_doc").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.col("_at").alias("at"))).alias("_first")
    spread = lines.groupBy("_line").agg(F.hll_sketch_agg(F.col("_site").cast("string"), LG_K).alias("_sketch"), first)
    spread = spread.select("_line", "_first", F.coalesce(F.hll_sketch_estimate("_sketch"), F.lit(0)).alias("_sites"))
    error = ERRORS * 1.04 / (1 << LG_K) ** 0.5 * min_sites + 1
    spread = stage(spread.where(F.col("_sites") > min_sites - error), f"{path}/spread")  # the others are below by far
    near = spread.where(F.col("_sites") < min_sites + error).select("_line")
    exact = salted(lines.select("_doc", "_line", "_site"), near).groupBy("_line").agg(F.countDistinct("_site").alias("_exact"))
    out = spread.join(exact, "_line", "left").where(F.coalesce("_exact", "_sites") >= min_sites).select("_line", "_first")
    return stage(out, f"{path}/boilerplate")


def salted(lines: DataFrame, few: DataFrame) -> DataFrame:
    """The lines that are in ``few`` (unique by _line): each of these SALTS times, so that a frequent one's rows are spread."""
    salts = few.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return lines.withColumn("_salt", F.pmod(F.xxhash64("_doc"), F.lit(SALTS)).cast("int")).join(salts, ["_line", "_salt"]).drop("_salt")


def without(lines: Column, gone: Column) -> Column:
    """An array without the elements at some places, in one pass: the array is bound once, places are taken off by hashing."""
    places = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), gone)
    return F.get(F.transform(F.array(lines), lambda own: F.transform(places(own), lambda i: F.get(own, i))), F.lit(0))


def remove(
    docs: DataFrame, path: str, site: str = "source", min_sites: int = 3, min_chars: int = 1,
    doc_id: str = "doc_id", text: str = "text", n_lines: str = "_n_lines", n_removed: str = "_n_removed"
) -> DataFrame:
    """The documents with boilerplate lines taken out of ``text``, and two columns: ``n_lines`` and ``n_removed``."""
    docs = docs.drop(n_lines, n_removed)
    lines = stage(occurrences(docs, site, min_chars, doc_id, text), f"{path}/lines")  # some 20 bytes a line: texts are split once
    found = salted(lines.select("_doc", "_at", "_line"), boilerplate(lines, path, min_sites))
    again = (F.coalesce(F.col("_doc").cast("long"), F.lit((1 << 63) - 1)) != F.col("_first.doc")) | (F.col("_at") != F.col("_first.at"))
    of, at = own_name(docs, "_of"), own_name(docs, "_gone")
    gone = found.where(again).groupBy(F.col("_doc").alias(of)).agg(F.collect_set("_at").alias(at))
    out = docs.join(gone, docs[doc_id].eqNullSafe(gone[of]), "left")
    count = F.size(F.filter(line_array(text), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    removed = F.coalesce(F.size(at), F.lit(0))
    clean = F.when(removed > 0, F.array_join(without(line_array(text), F.col(at)), "\n")).otherwise(F.col(text))
    return out.withColumns({n_lines: F.coalesce(count, F.lit(0)), n_removed: removed, text: clean}).drop(of, at)
