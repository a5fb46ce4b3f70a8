"""Column functions on single reads; all run inside the JVM.

Sequences are ASCII, so characters and bytes are the same; case is changed for ASCII letters only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL = "abcdefghijklmnopqrstuvwxyz"
LARGE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What a colour digit makes of the base before it.
COLOURS = {"0": "ACGT", "1": "CATG", "2": "GTAC", "3": "TGCA"}


def upper_ascii(seq: Column | str) -> Column:
    return F.translate(seq, SMALL, LARGE)


def reverse_complement(seq: Column | str) -> Column:
    """Other letters than A, C, G and T stay."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def is_casava_filtered(read_id: Column | str) -> Column:
    return F.contains(read_id if isinstance(read_id, Column) else F.col(read_id), F.lit(":Y:"))


def is_colorspace(seq: Column | str) -> Column:
    return (seq if isinstance(seq, Column) else F.col(seq)).rlike("^[GATCNgatcn][0-6.]+$")


def colorspace_to_bases(seq: Column) -> Column:
    """The bases after the first, which is the primer's: each colour changes the base before it; what can't be told is N,
    and so is all behind it."""
    def step(state: Column, colour: Column) -> Column:
        before = F.substring(state, -1, 1)
        next_base = F.lit("N")
        for digit, to in COLOURS.items():
            next_base = F.when(colour == digit, F.translate(before, "ACGT", to)).otherwise(next_base)
        return F.concat(state, F.when(before == "N", F.lit("N")).otherwise(next_base))

    colours = F.split(F.substring(seq, F.lit(2), F.length(seq)), "")
    return F.when(F.length(seq) < 2, F.lit("")).otherwise(
        F.aggregate(colours, upper_ascii(F.substring(seq, F.lit(1), F.lit(1))), step, lambda s: F.substring(s, F.lit(2), F.length(s)))
    )


def soft_clip_sizes(cigar: Column) -> tuple[Column, Column]:
    """Bases clipped at the 5' and the 3' end; an empty match counts as none."""
    size = lambda p: F.coalesce(F.regexp_extract(cigar, p, 1).try_cast("int"), F.lit(0))
    return size(r"^(\d+)S"), size(r"(\d+)S$")


def clip_soft(value: Column, cigar: Column) -> Column:
    """A sequence or quality string without soft-clipped ends: first the 3' end, then the 5' end if it still fits."""
    five, three = soft_clip_sizes(cigar)
    three = F.when((three > 0) & (three <= F.length(value)), three).otherwise(0)
    kept = F.length(value) - three
    five = F.when((five > 0) & (five <= kept) & cigar.rlike(r"^\d+S."), five).otherwise(0)
    return F.substring(value, five + 1, kept - five)


def duplicate_key(seq: Column, dup_length: int = 0) -> Column:
    """The part of a read by which copies are told."""
    n = F.length(seq)
    key = F.when(n > 50, F.substring(seq, 1, 50)).otherwise(seq)
    return F.when(n > dup_length, F.substring(seq, 1, dup_length)).otherwise(key) if dup_length > 0 else key


def gc_part(seq: Column) -> Column:
    """Reads over 1000 bases count in whole thousands, those over 100 in whole hundreds."""
    n = F.length(seq)
    whole = lambda unit: F.substring(seq, F.lit(1), (F.floor(n / unit) * unit).cast("int"))
    return F.when(n > 1000, whole(1000)).when(n > 100, whole(100)).otherwise(seq)


def count_letters(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_count(seq: Column) -> Column:
    return count_letters(seq, "GC")


def n_count(seq: Column) -> Column:
    return count_letters(seq, "Nn")


def codes(quality: Column) -> Column:
    """The quality characters' codes."""
    return F.transform(F.split(quality, ""), lambda c: F.ascii(c))


def mean_code(quality: Column) -> Column:
    """Whole mean of the codes of a string that isn't empty."""
    return F.floor(F.aggregate(codes(quality), F.lit(0).cast("long"), lambda a, c: a + c) / F.length(quality)).cast("int")


def tile_field(read_id: Column) -> Column:
    """Which field of the id, from 1 on, has the tile: the fifth of seven or more, the third of five or more, else none."""
    n = F.size(F.split(read_id, ":"))
    return F.when(n >= 7, 5).when(n >= 5, 3)


def tile(read_id: Column, field: Column) -> Column:
    """Null where the id is too short or the field isn't a whole number."""
    return F.try_element_at(F.split(read_id, ":"), field).try_cast("int")


def find_position(seq: Column, part: str) -> Column:
    """0-based place of the first occurrence; null if there is none."""
    at = F.instr(seq, F.lit(part))
    return F.when(at > 0, at - 1)


def phred_offset(lowest: Column) -> Column:
    return F.when(lowest < 64, 33).otherwise(64)


def phred_name(lowest: Column) -> Column:
    return F.when(lowest < 64, "Sanger / Illumina 1.9").when(lowest < 66, "Illumina 1.3").otherwise("Illumina 1.5")
