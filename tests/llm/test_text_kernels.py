import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import bpe_prefix as B
from seqloom.llm import kernels as K
from seqloom.llm import packing, quality, toxicity
from seqloom.llm.eliasfano import EliasFano
from seqloom.llm.piececache import PieceCache, gather

TEXT = st.lists(st.sampled_from([*"aeBT \t\n.'sréü日0²!", "the", "ing", "  ", "'ll", "\xa0", "🙂"]), max_size=30).map("".join)


@given(st.lists(TEXT, max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_are_bytes_between_white_space(texts):
    known = {}
    for _, _, h, n in K.column_words(pa.array([*texts, None], pa.string())):
        words = [t.encode().lower().split() for t in [*texts, ""]]
        assert n.tolist() == [len(w) for w in words]
        for word, code in zip([w for ws in words for w in ws], h.tolist(), strict=True):
            assert known.setdefault(word, code) == code
    assert len(set(known.values())) == len(known)


def thue_morse(n):
    """Words on which every polynomial in an odd base collides modulo 2**64: a word of n letters and its complement."""
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_thue_morse_words_have_hashes_of_their_own():
    for n in (1 << 11, 1 << 12):
        one, other = thue_morse(n)
        (_, _, h, _), = K.column_words(pa.array([f"{one} {other}"]))
        assert h[0] != h[1]
        raw = np.frombuffer((one + other).encode(), np.uint8)
        a, b = K.span_hashes(raw, np.array([0, n]), np.array([n, 2 * n]), second=True)
        assert len({*a.tolist(), *b.tolist()}) == 4


def test_spans_may_be_empty_and_overlap():
    raw = np.frombuffer(b"abcabc", np.uint8)
    h = K.span_hashes(raw, np.array([0, 2, 3, 0, 6]), np.array([3, 2, 6, 6, 6]))
    assert h[0] == h[2]
    assert h[1] == h[4]
    assert len(set(h.tolist())) == 3


def test_pieces_with_equal_first_hashes_get_their_own_ids():
    cache = PieceCache(np.dtype(np.int32))
    pieces = [b"x", b"yy", b"x", b"zzz", b"yy"]
    h, check = np.array([7, 7, 7, 7, 9], np.uint64), np.array([1, 2, 1, 3, 2], np.uint64)
    for _ in range(2):
        ids, n = cache.ids(h, check, lambda at: [np.array([*pieces[i]], np.int32) for i in at.tolist()])
        assert ids.tobytes() == np.array([*b"".join(pieces)], np.int32).tobytes()
        assert n.tolist() == [len(p) for p in pieces]


@given(st.lists(st.integers(0, 1 << 40), max_size=80).map(sorted), st.lists(st.integers(0, (1 << 40) + 5), max_size=30))
@settings(max_examples=80, deadline=None)
def test_elias_fano_finds_what_binary_search_finds(values, asked):
    v = np.array(values, np.uint64)
    e = EliasFano.build(v)
    assert (e.get(np.arange(len(v))) == v).all()
    q = np.array(asked, np.uint64)
    place, value = e.successor(q)
    want = np.searchsorted(v, q)
    assert (place == want).all()
    inside = want < len(v)
    assert (value[inside] == v[want[inside]]).all()


def test_gather_takes_runs():
    pool = np.arange(100)
    start, size = np.array([5, 90, 3, 7]), np.array([2, 0, 4, 1])
    assert gather(pool, start, size).tolist() == [5, 6, 3, 4, 5, 6, 7]


@pytest.fixture(scope="module")
def encoder():
    return B.Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = B.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_the_fast_splitter_is_for_the_installed_pattern():
    assert B.SPLIT_PATTERN == P.PATTERN


def test_split_points_are_the_patterns_matches():
    @given(st.lists(TEXT, min_size=1, max_size=6))
    @settings(max_examples=150, deadline=None)
    def check(texts):
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if len(points):
            starts = np.cumsum([len(t) for t in texts]) - [len(t) for t in texts]
            want = [a + m.start() for a, t in zip(starts.tolist(), texts, strict=True) for m in regex.finditer(P.PATTERN, t)]
            assert B.split_points(points, starts).tolist() == want

    check()


def test_bpe_equals_the_library_and_decodes(encoder, reference):
    @given(st.lists(TEXT, max_size=5))
    @settings(max_examples=60, deadline=None)
    def check(texts):
        ids, n = encoder.texts(texts)
        want = [reference.encode_ordinary(t) for t in texts]
        assert ids.tolist() == [i for w in want for i in w]
        assert n.tolist() == [len(w) for w in want]
        assert encoder.decode(ids).tobytes() == "".join(texts).encode()

    check()
    texts = list(thue_morse(1 << 11))
    ids, n = encoder.texts(texts)
    assert ids.tolist() == [i for t in texts for i in reference.encode_ordinary(t)]


def test_appends_and_edits_of_a_prefix_table(encoder, reference):
    @given(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from([b"", b"the", b" x", b"\xff"]))
    @settings(max_examples=60, deadline=None)
    def check(data, a, b, new):
        a, b = sorted((min(a, len(data)), min(b, len(data))))
        table = B.PrefixTable(encoder.v, data[:a])
        table.append(data[a:])
        table.replace(a, b, new)
        want = data[:a] + new + data[b:]
        assert table.data == want
        assert table.tokens() == encoder.v.merged(want)
        if want:
            assert table.tokens() == reference._encode_single_piece(want)

    check()


def test_word_tokenizer_equals_the_library():
    tok = packing.WordTokenizer(P.path("word_bpe_49k.json"))

    @given(st.lists(TEXT | st.sampled_from(["a<|endoftext|>b", "<|ENDOFTEXT|>", "Word.,! Word"]), min_size=1, max_size=5))
    @settings(max_examples=60, deadline=None)
    def check(texts):
        raw, off = K.column_bytes(pa.array(texts))
        ids, n = tok.encode(raw, off)
        want = [tok.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in want for i in w]
        assert n.tolist() == [len(w) for w in want]

    check()
    texts = [" ".join(thue_morse(1 << 11)), *thue_morse(1 << 12)]
    ids, _ = tok.encode(*K.column_bytes(pa.array(texts)))
    assert ids.tolist() == [i for t in texts for i in tok.tok.encode(t, add_special_tokens=False).ids]


@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0.0, 2.0, 5.0])), min_size=1, max_size=14))
@settings(max_examples=80, deadline=None)
def test_cuts_are_the_cheapest(steps):
    places = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    penalty = np.array([0.0] + [p for _, p in steps])
    cuts = packing.cut_windows(places, penalty, 10)

    def cost(cut):
        at = np.concatenate([[0], places[cut]])
        return sum(penalty[cut]) + sum(10 - d for d in np.diff(at))

    best = [0.0] + [np.inf] * len(steps)
    for j in range(1, len(places)):
        best[j] = min(best[i] + 10 - (places[j] - places[i]) + penalty[j] for i in range(j) if places[j] - places[i] <= 10)
    assert cuts[-1] == len(steps)
    assert cost(cuts) == pytest.approx(best[-1])


def test_quality_model_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.95
    assert {0, 1} in [set(p) for p in model.pairs]


def test_features_of_empty_texts_are_zero():
    raw, off = K.column_bytes(pa.array(["", None, "a b"]))
    x = quality.features(raw, off)
    assert not x[:2].any()
    assert x[2].any()


def test_elias_fano_sequences_side_by_side():
    rng = np.random.default_rng(5)
    parts = [np.sort(rng.integers(0, top, n, dtype=np.uint64)) for n, top in ((0, 1), (700, 90), (1, 1 << 40), (3000, 1 << 34), (0, 1), (64, 64), (5000, 5100))]
    e = EliasFano.join([EliasFano.build(p) for p in parts])
    for k, p in enumerate(parts):
        sec = np.full(len(p), k)
        assert (e.get(np.arange(len(p)), sec) == p).all()
        if len(p) > 1:
            one, two = e.get_two(np.arange(len(p) - 1), sec[1:])
            assert (one == p[:-1]).all()
            assert (two == p[1:]).all()
        ask = np.concatenate([p, p + np.uint64(1), rng.integers(0, 1 << 41, 50, dtype=np.uint64)])
        want = np.searchsorted(p, ask)
        there = np.append(p, np.uint64(1 << 63))[want] == ask
        assert (e.locate(ask, sec=np.full(len(ask), k)) == np.where(there, want, -1)).all()


def test_toxic_words_ignore_marks_around_them():
    raw, off = K.column_bytes(pa.array(["Idiot! (idiot)", "", "idiot"]))
    h, before, n = toxicity.text_words(raw, off)
    assert n.tolist() == [2, 0, 1]
    assert len(set(h.tolist())) == 1
    assert before.tolist() == [0, int(h[0]), 0]
