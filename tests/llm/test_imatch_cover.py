from pyspark.sql import functions as F

from seqloom.llm import imatch

TERMS = [f"w{i}" for i in range(120)]
TEXTS = [*TERMS, "w1 w2 w3", "w1 w2 w4", "w1  W2\tw3", " ".join(TERMS), " ".join(TERMS[:-1]), " ".join(TERMS[:60]), " ".join(TERMS[40:]), "nothing known"]


def test_fingerprints_and_likeness_equal_brute_force(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    terms = imatch.F.row_number().over(imatch.Window.orderBy("term")).alias("place")
    lexicon = spark.createDataFrame([(t,) for t in TERMS], "word string").select(imatch.F.xxhash64("word").alias("term")).select("term", terms)
    own = imatch.fingerprints(rows, lexicon)
    k1, k2 = imatch.keys(imatch.F.col("text"))
    named = imatch.with_rest(
        rows.select("text", k1.alias("f_k1"), k2.alias("f_k2")).join(
            own.select(imatch.F.col("k1").alias("f_k1"), imatch.F.col("k2").alias("f_k2"), imatch.F.col("fingerprint").alias("f")),
            ["f_k1", "f_k2"], "left"
        ),
        "f"
    ).select("text", "f").cache()
    found = {r.text: r.f for r in named.collect()}
    place = {}
    for t in TERMS:  # each term is in one subset
        (place[t],) = [k for k, h in enumerate(found[t]) if h]
    assert len(set(place.values())) > imatch.SUBSETS / 2

    def subsets(text):
        used = {w for w in text.lower().split() if w in place}
        return [frozenset(w for w in used if place[w] == k) for k in range(imatch.SUBSETS)]

    want = {t: subsets(t) for t in TEXTS}
    assert all([bool(s) for s in want[t]] == [h != 0 for h in found[t]] for t in TEXTS[:-1])
    assert all(found["nothing known"])
    pairs = named.toDF("ta", "a").crossJoin(named.toDF("tb", "b")).select("ta", "tb", imatch.likeness("a", "b").alias("x")).collect()
    for r in pairs:
        both = list(zip(want[r.ta], want[r.tb], strict=True))
        some = sum(bool(x or y) for x, y in both)
        same = 1.0 if r.ta == r.tb else sum(x == y and bool(x) for x, y in both) / some
        assert abs(r.x - same) < 1e-12, (r.ta, r.tb)


def test_ranges_are_constants_of_the_plan(spark):
    """As many ranges as there are documents: the plan has the same nodes as for a few, and neighbours are the same."""
    rows = [(i * 3 % 400 - 50, f"text {i}") for i in range(400)] + [(7, "again"), (7, None), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, nodes = [], []
    for n in (1, 8, 800):
        out = imatch.next_documents(docs, n)
        nodes.append(out._jdf.queryExecution().analyzed().toString().count("+-"))
        found.append(sorted(map(str, out.collect())))
    assert found[0] == found[1] == found[2] and len(set(nodes)) == 1
    limits = [1, 5, 5, 9]
    df = spark.createDataFrame([(x,) for x in (None, 0, 1, 4, 5, 8, 9, 10)], "doc_id long")
    got = [r[0] for r in df.select(imatch.range_of(F.col("doc_id"), limits)).collect()]
    assert got == [0, 0, 1, 1, 3, 3, 4, 4]
