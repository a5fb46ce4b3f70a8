"""Secret scans with DataFrame functions only (operator 3).

Fixed kinds are regular expressions.  The method adds other random-looking strings: two first-order Markov models of characters,
one of random strings and one of ordinary identifiers, are trained from labelled samples by counting adjacent characters; a
candidate's log-likelihood ratio is the sum of its transitions' entries in one table.  The models have ALPHABET's size squared
entries whatever the samples' size, and the table travels in the plan.

A match's place isn't given by Spark's functions; it follows from the lengths of the gaps that split() leaves and of the matches
that regexp_extract_all() finds, added up once along a text.  Only texts with a match are split.

The ratio decides on every candidate, and has to be higher where a candidate has no digit or no letter.  A learned span inside a
base span adds nothing and goes; one that reaches beyond stays whole, beside the base span.

Edge cases: a null or empty text has no spans; a text of any length is scanned whole; spans are code points, end exclusive, of
the whole match; spans that begin alike (ties) come by kind; a null doc_id is a row like others; repeated rows repeat; an empty
table gives no rows; other columns are kept, whatever their names, but for those named like the two new ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import own_name

# Fixed kinds: name, pattern, and the least length of its second group, if that counts.  A run of too few letters holds no long
# one, so that the least lengths of the others are in their patterns; a short assignment takes up what a later one might begin with.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"AKIA[A-Z0-9]{12,}", None),
    ("hex", r"[0-9a-f]{32,}", None),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEARNED = "markov"
NAMES = [k[0] for k in KINDS] + [LEARNED]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SPANS = "array<struct<start:int,kind:int,end:int>>"
REPLACEMENT = "[SECRET]"
CHUNK = 256  # spans of a text that are dealt with at a time
UNMIXED = 2.0  # times the ratio that candidates with digits and letters need

# Parts of the ordinary identifiers that the default samples are made of.
PARTS = "get set user name value index count list item file path data key page line text node size type first last time date max min new old left right main test view model form base code read write open close start stop send call event error state table column row total price order sum group width height image color button click handle update delete create parse build load save cache query result config option default string number".split()
SYLLABLES = "the of and tion ing er an in on en re ed th at ti es or nd ha he is it ou ea st nt ly ble sh wh de la le qu eau ment pa ch ver ung sch lich keit und zu ge be ein ción os as ue que tra ndo mente".split()


def default_samples(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """(text, label): random strings of several alphabets are 1, identifiers and invented words are 0; made by a rule."""
    n = spark.range(rows).select("id", F.sha2(F.concat(F.lit("r"), F.col("id")), 256).alias("a"), F.sha2(F.concat(F.lit("s"), F.col("id")), 256).alias("b"))
    b64 = F.base64(F.unhex(F.concat("a", "b")))
    size = (F.lit(20) + F.col("id") % 29).cast("int")
    kind = F.col("id") % 4
    random = n.select(
        F.when(kind == 0, F.substring("a", F.lit(1), size)).when(kind == 1, F.substring(b64, F.lit(1), size)).when(
            kind == 2, F.substring(F.regexp_replace(b64, "[+/=]", "x"), F.lit(1), size)
        ).otherwise(F.upper(F.substring(F.regexp_replace(b64, "[+/=]", "7"), F.lit(1), size))).alias("text"),
        F.lit(1).alias("label")
    )

    def pick(words: list[str], k: int) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(words))) + 1).cast("int"))

    part, syl = [pick(PARTS, k) for k in range(5)], [pick(SYLLABLES, 10 + k) for k in range(7)]
    kind = F.col("id") % 6
    ordinary = spark.range(rows).select(
        F.when(kind == 0, F.concat_ws("_", *part[:4])).when(kind == 1, F.concat(part[0], *map(F.initcap, part[1:5]))).when(kind == 2, F.upper(F.concat_ws("_", *part[:4]))).when(kind == 3, F.concat_ws("/", *part[:4])).when(kind == 4, F.concat(F.initcap(syl[0]), *syl[1:])).otherwise(
            F.concat_ws("-", *part[:3], (F.col("id") % 97).cast("string"))
        ).alias("text"),
        F.lit(0).alias("label"),
    )
    return random.unionAll(ordinary)


def train(samples: DataFrame, add: float = 0.5) -> list[float]:
    """Log ratios of transition probabilities, random to ordinary, for each ordered pair of characters of ALPHABET."""
    k = len(ALPHABET)
    pairs = samples.where(F.col("text").isNotNull() & F.col("label").isin(0, 1)).select(
        "label",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.substring("text", i, F.lit(2)))
        ).alias("pair")
    )
    counts = pairs.where(F.length("pair") == 2).groupBy("label", "pair").count().collect()  # at most 2 * k * k rows count
    found = [[[add] * k for _ in range(k)] for _ in range(2)]
    for label, pair, n in counts:
        a, b = ALPHABET.find(pair[0]), ALPHABET.find(pair[1])
        if a >= 0 and b >= 0:
            found[label][a][b] += n
    return [round(math.log(found[1][a][b] / sum(found[1][a])) - math.log(found[0][a][b] / sum(found[0][a])), 6) for a in range(k) for b in range(k)]


def ratio(text: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a string over ALPHABET."""
    k = len(ALPHABET)
    cells, places = F.lit(table), F.lit([max(0, ALPHABET.find(chr(c))) for c in range(128)])  # two constants of the plan
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))

    def step(s: Column, c: Column) -> Column:
        at = F.get(places, F.ascii(c))
        return F.struct(at.alias("before"), F.when(s["before"] >= 0, s["sum"] + F.get(cells, s["before"] * k + at)).otherwise(s["sum"]).alias("sum"))

    return F.aggregate(F.split(text, ""), start, step, lambda s: s["sum"])


def _chunks(items: Column | str, carry: Column, onward) -> Column:
    """Parts of CHUNK items, each with what ``onward`` carries up to its beginning and its end: arrays that grow item by item, or
    texts that are cut at places, would otherwise cost the square of a long text's matches."""
    items = F.col(items) if isinstance(items, str) else items
    upto = lambda n: F.aggregate(F.slice(items, F.lit(1), n), carry, onward)
    last = F.greatest(F.floor((F.size(items) - 1) / CHUNK).cast("int"), F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last), lambda c: F.struct(
            upto(c * CHUNK).alias("begin"), upto(F.least(c * CHUNK + CHUNK, F.size(items))).alias("end"), F.slice(items, c * CHUNK + 1, F.lit(CHUNK)).alias("part")
        )
    )


def _found(df: DataFrame, text: str, out: str, kind: int, pattern: str, keep) -> DataFrame:
    """A column of spans of the matches that ``keep`` accepts."""
    hits, gaps = own_name(df, "hits"), own_name(df, "gaps")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    df = df.withColumn(hits, F.transform(found, lambda h: F.struct(F.length(h).alias("size"), keep(h).alias("ok"))))  # asked once a match
    df = df.withColumn(gaps, F.when(F.exists(hits, lambda h: h["ok"]), F.split(text, pattern, -1)))
    each = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), h["size"].alias("size"), h["ok"].alias("ok")))
    none = F.array().cast(SPANS)

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"))
        return F.struct((start + x["size"]).alias("at"), F.when(x["ok"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    rows = own_name(df, "each")
    parts = _chunks(rows, F.lit(0), lambda a, x: a + x["gap"] + x["size"])
    spans = F.flatten(F.transform(parts, lambda c: F.aggregate(c["part"], F.struct(c["begin"].alias("at"), none.alias("out")), step, lambda a: a["out"])))
    return df.withColumn(rows, each).withColumn(out, F.coalesce(F.when(F.col(gaps).isNotNull(), spans), none)).drop(hits, gaps, rows)


def scan(
    docs: DataFrame, table: list[float], text: str = "text", least_ratio: float = 20.0,
    least_mean: float = 0.8, base: str = "base", spans: str = "spans"
) -> DataFrame:
    """The documents with ``base`` and ``spans``: arrays of (start, kind, end) in order, a kind being a place in NAMES."""
    docs = docs.drop(base, spans)
    own = own_name(docs, "scanned")
    df = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    kinds = []
    for k, (name, pattern, least) in enumerate(KINDS):
        kinds.append(own_name(df, name))
        df = _found(df, own, kinds[-1], k, pattern, _long_enough(pattern, least))
    learned = own_name(df, "learned")
    df = _found(df, own, learned, len(KINDS), CANDIDATE, lambda x: _random_looking(x, table, least_ratio, least_mean))
    df = df.withColumn(base, F.array_sort(F.concat(*kinds)))
    return df.withColumn(spans, F.array_sort(F.concat(base, learned))).withColumn(
        spans, F.when(F.size(learned) > 0, _with_learned(F.col(spans))).otherwise(F.col(base))
    ).drop(own, learned, *kinds)


def _with_learned(spans: Column) -> Column:
    """Sorted spans without the learned ones that lie in a base one: as that begins no later, it is known by the furthest end so far."""

    def step(a: Column, s: Column) -> Column:
        extra = s["kind"] == len(KINDS)
        return F.struct(
            F.when(extra, a["most"]).otherwise(F.greatest(a["most"], s["end"])).alias("most"),
            F.when(extra & (s["end"] <= a["most"]), a["out"]).otherwise(F.concat(a["out"], F.array(s))).alias("out")
        )

    onward = lambda a, s: F.when(s["kind"] == len(KINDS), a).otherwise(F.greatest(a, s["end"]))
    none = F.array().cast(SPANS).alias("out")
    return F.flatten(F.transform(_chunks(spans, F.lit(-1), onward), lambda c: F.aggregate(c["part"], F.struct(c["begin"].alias("most"), none), step, lambda a: a["out"])))


def _long_enough(pattern: str, least: int | None):
    return lambda x: F.length(F.regexp_extract(x, pattern, 2)) >= least if least else F.lit(True)


def _random_looking(x: Column, table: list[float], least_ratio: float, least_mean: float) -> Column:
    mixed = x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    return ratio(x, table) >= F.greatest(F.lit(least_ratio), F.length(x) * least_mean) * F.when(mixed, 1.0).otherwise(UNMIXED)


def spans_text(spans: Column | str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(scanned: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """Texts with each run of overlapping spans replaced; ``base`` and ``spans`` go.  A text without spans stays as it is."""
    own = F.col(text)
    cut = F.transform(
        _chunks(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"])),
        lambda c: F.struct(c["begin"].alias("begin"), c["part"].alias("part"), F.substring(own, c["begin"] + 1, c["end"] - c["begin"]).alias("text"))
    )

    def pieces(c: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            more = F.array(F.substring(c["text"], a["at"] - c["begin"] + 1, s["start"] - a["at"]), F.lit(REPLACEMENT))
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], more)).otherwise(a["out"]).alias("out"))

        start = F.struct(c["begin"].alias("at"), F.array().cast("array<string>").alias("out"))
        return F.array_join(F.aggregate(c["part"], start, step, lambda a: a["out"]), "")

    end = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    clean = F.concat(F.array_join(F.transform(cut, pieces), ""), F.substring(own, end + 1, F.length(own)))
    return scanned.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(own)).drop(base, spans)
