"""A Merkle manifest of a dataset, with a proof for each row, by pointer jumping (operator 13).

Rows of a group are leaves in order; each two neighbours become a node, the last alone if they are odd, until one is left, the
group's subroot.  The subroots, in the order of their groups, are the leaves of one more tree, whose root stands for everything.

Places in a group come from ranges: rows are dealt out by ranges of (group, order, digest), sorted, and numbered as they lie;
where a group goes on in the next range it is carried on by a sum over ranges.  Subtrees of 2^BITS leaves are built by one task
each.  Then every node holds the siblings on its way to an ancestor, at first its parent.  A self-join of the nodes' table appends
the ancestor's own siblings, which doubles the distance: after as many joins as the depth has binary digits each leaf's siblings
reach the root.  Before the jump by 2^j only nodes on levels that are multiples of 2^j are needed, so that the side that is looked
up shrinks by 2^(2^j); it is broadcast where its rows, counted first, are few enough, and otherwise has at most 2^(2^j) rows for
a key, few against all.

Edge cases: a null group comes first and is one of its own; null values are part of a leaf as ``-``; rows with a null order come
first; rows alike in group and order (ties) come by digest, and equal rows are leaves of their own with proofs of their own; texts
of any length and empty ones are hashed whole; an empty table has no rows and no root; other columns don't count.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import remove, stage

BITS = 10  # levels that a task builds at once
FEW = 100_000  # siblings of 33 bytes that are broadcast at most
ROWS_A_FILE = 100_000  # of nodes or ways, some hundred bytes each: few rows aren't written as a small file for each task
PARTED = 16  # into so many parts the rows of a group are dealt where its own row can't be broadcast
STEP = "array<struct<right:boolean,sibling:binary>>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*values: Column) -> Column:
    """Hex digest of the values: each by its number of bytes and itself, or as ``-``."""
    part = lambda v: F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
    return F.sha2(F.concat(*(part(v.cast("string")) for v in values)), 256)


def places(rows: DataFrame, path: str, group: str, order: list[str]) -> DataFrame:
    """Adds ``pos`` (from 0, in ``order``) and ``total`` to rows of a written table, by group (never null)."""
    names = [*rows.columns, "_row"]
    keys = [group, *order, "_alike"]  # equal rows may be parted, too
    dealt = rows.withColumn("_alike", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = stage(dealt.withColumn("_row", F.monotonically_increasing_id()).select(*names), path)
    dealt = dealt.withColumn("_range", F.shiftright("_row", 33))
    first = dealt.groupBy("_range", group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    of = Window.partitionBy(group)  # a row a range
    before = F.coalesce(F.sum("_n").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("_range", group, "_first", before.alias("_before"), F.sum("_n").over(of).alias("total"))
    out = dealt.join(first, ["_range", group])
    return out.withColumn("pos", F.col("_before") + F.col("_row") - F.col("_first")).drop("_range", "_row", "_first", "_before")


def _subtree(table: pa.Table, base: int, bits: int) -> pa.Table:
    """The nodes of up to ``bits`` levels above neighbours of a group, each with its sibling; ``carry`` marks what is built on."""
    group, total = table["grp"][0].as_py(), table["total"][0].as_py()
    depth = (total - 1).bit_length()
    order = np.argsort(pos := table["pos"].to_numpy())
    first, digests = int(pos[order[0]]), [table["digest"][int(i)].as_py() for i in order]
    level, out = base, []
    while level < min(base + bits, depth):
        for i, d in enumerate(digests):
            sibling = digests[i ^ 1] if i ^ 1 < len(digests) else None
            out.append((level, first + i, d, i % 2 == 0, sibling, False))
        hexed = [d.hex() for d in digests]
        digests = [hashlib.sha256("".join(hexed[i : i + 2]).encode()).digest() for i in range(0, len(hexed), 2)]
        level, first = level + 1, first >> 1
    out += [(level, first + i, d, True, None, True) for i, d in enumerate(digests)]
    columns = list(zip(*out, strict=True))
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.binary(), pa.bool_()]
    arrays = [pa.array([group] * len(out), pa.string()), pa.array([total] * len(out), pa.int64())] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.Table.from_arrays(arrays, ["grp", "total", "level", "pos", "digest", "right", "sibling", "carry"])


def _builder(base: int, bits: int):
    def build(table):  # noqa: ANN001  Spark can't read hints that are text
        return _subtree(table, base, bits)

    return build


def nodes(leaves: DataFrame, path: str) -> tuple[DataFrame, int]:
    """(grp, level, pos, digest, right, sibling, top) of all trees over leaves (grp, pos, total, digest), and the greatest depth."""
    most, rows = leaves.agg(F.max("total"), F.count("*")).first()
    most, files = most or 0, -(-rows // ROWS_A_FILE) or 1
    deepest = max(most - 1, 0).bit_length()
    at, parts, bits = leaves.select("grp", "pos", "total", "digest"), [], BITS
    for n, base in enumerate(range(0, max(deepest, 1), bits)):
        grouped = at.groupBy("grp", F.shiftright("pos", bits).alias("_block"))
        built = grouped.applyInArrow(
            _builder(base, bits), "grp string, total long, level int, pos long, digest binary, right boolean, sibling binary, carry boolean"
        )
        built = stage(built.coalesce(files), f"{path}/level{n}")
        # what is carried beyond its level's last node is a node of the next round
        top = F.expr("carry AND shiftleft(1L, level) >= total")
        built = built.withColumn("top", top)
        parts.append(built.where("top OR NOT carry").drop("carry", "total"))
        at = built.where("carry AND NOT top")
    return reduce(DataFrame.unionAll, parts), deepest


def look_up(left: DataFrame, right: DataFrame, on: list[str], how: str, few: int) -> DataFrame:
    """A join by keys that ``right`` has once: broadcast where ``right`` has at most ``few`` rows (counted), else by shuffle."""
    return left.join(F.broadcast(right) if right.count() <= few else right, on, how)


def proofs(trees: DataFrame, deepest: int, path: str) -> DataFrame:
    """(grp, pos, proof) for each leaf: (right, sibling) from the lowest level to the top; a lone node's sibling is null."""
    own = F.when(F.col("top"), F.array().cast(STEP)).otherwise(F.array(F.struct("right", "sibling")))
    at, jump, last = trees.select("grp", "level", "pos", own.alias("way")), 1, None
    files = -(-trees.count() // ROWS_A_FILE) or 1
    while jump < deepest:
        on = F.col("level") % (2 * jump)
        upper = at.where(on == jump).select("grp", F.col("level").alias("_level"), F.col("pos").alias("_pos"), F.col("way").alias("_way"))
        lower = at.where(on == 0).withColumns({"_level": F.col("level") + jump, "_pos": F.shiftright("pos", jump)})
        joined = look_up(lower, upper, ["grp", "_level", "_pos"], "left", FEW // jump)
        at = stage(joined.select("grp", "level", "pos", F.concat("way", F.coalesce("_way", F.array().cast(STEP))).alias("way")).coalesce(files), f"{path}/jump{jump}")
        if last:
            remove(trees.sparkSession, last)
        last, jump = f"{path}/jump{jump}", 2 * jump
    return at.where("level = 0").select("grp", "pos", F.col("way").alias("proof"))


def hexed(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def fold(digest: Column, proof: Column | str) -> Column:
    """The root that follows from a leaf (hex) and the siblings of its way."""

    def step(d: Column, s: Column) -> Column:
        other = F.coalesce(hexed(s["sibling"]), F.lit(""))
        return F.sha2(F.when(s["right"], F.concat(d, other)).otherwise(F.concat(other, d)), 256)

    return F.aggregate(proof, digest, step)


def proof_digest(proof: Column | str) -> Column:
    return F.sha2(F.array_join(F.transform(F.filter(proof, lambda s: s["sibling"].isNotNull()), lambda s: hexed(s["sibling"])), ""), 256)


def trees(rows: DataFrame, path: str, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (a written table with ``digest``) with ``pos`` and ``proof`` in their group's tree, and (grp, subroot)."""
    placed = stage(places(rows, f"{path}/ranges", group, order), f"{path}/placed")
    every, deepest = nodes(placed.withColumnRenamed(group, "grp"), path)
    ways = proofs(every, deepest, path).withColumnRenamed("grp", group)
    return placed.join(ways, [group, "pos"]), every.where("top").select(F.col("grp").alias(group), F.col("digest").alias("subroot"))


def manifest(
    docs: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None
) -> DataFrame:
    """(order, ``keep``'s columns, leaf, subroot, root, proof), a row for each of ``docs``."""
    keep = keep or {}
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("_group")  # null before all others
    digest = F.unhex(leaf(*(F.col(c) for c in columns))).alias("digest")
    rows = stage(docs.select(F.col(order).alias("_order"), key, digest, *(c.alias(n) for n, c in keep.items())), f"{path}/leaves")
    placed, subroots = trees(rows, f"{path}/groups", "_group", ["_order", "digest"])
    tops = stage(subroots.withColumns({"_all": F.lit("all"), "digest": F.col("subroot")}), f"{path}/subroots")
    above, root = trees(tops, f"{path}/top", "_all", ["_group"])
    root = root.first()
    above = above.select("_group", "subroot", F.col("proof").alias("_above"))
    if (groups := tops.count()) > FEW // 20:  # a group may hold a third of all rows
        parts = F.explode(F.sequence(F.lit(0), F.lit(PARTED - 1)))
        placed = placed.withColumn("_part", (F.col("pos") % PARTED).cast("int"))
        out = placed.join(above.withColumn("_part", parts), ["_group", "_part"])
    else:
        out = look_up(placed, above, ["_group"], "inner", groups)
    return out.select(
        F.col("_order").alias(order), *keep, hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"),
        F.lit(root["subroot"].hex() if root else None).cast("string").alias("root"), F.concat("proof", "_above").alias("proof")
    )
