import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import suffix


def plain(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]


@given(st.lists(st.text("ab\0", max_size=40).map(str.encode), min_size=1, max_size=8), st.integers(1, 20))
@settings(max_examples=400, deadline=None)
def test_expansion_is_brute_force(texts, length):
    assert [x.tolist() for x in suffix.repeats(texts, length)] == plain(texts, length)


def test_expansion_of_long_repeats():
    rnd = random.Random(3)
    passage = bytes(rnd.randrange(97, 123) for _ in range(900))
    texts = [bytes(rnd.randrange(97, 100) for _ in range(300)) + passage[rnd.randrange(200) :] + b"z" * rnd.randrange(900) for _ in range(12)]
    assert [x.tolist() for x in suffix.repeats(texts)] == plain(texts, 400)


def expected(texts, length):
    out = []
    for t, starts in zip(texts, plain(texts, length), strict=True):
        gone = set()
        for i in starts:
            gone.update(range(i, i + length))
        kept = bytes(b for i, b in enumerate(t) if i not in gone)
        spans = sum(i in gone and i - 1 not in gone for i in range(len(t)))
        out.append((len(t), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(length):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(length), prose(length // 3)
    texts = [None, "", "short", "a" * (length - 1), "a" * length, "b" * (3 * length), passage, passage, prose(20) + passage + prose(30), passage[5:] + passage]
    texts += [prose(40) + passage[: rnd.randrange(length, 3 * length)] + prose(10) + other for _ in range(25)]
    return texts + ["ab" * length, prose(500)]


def test_documents_match_brute_force(spark):
    for length, gram, limits in ((60, 12, {}), (60, 12, {"bucket": 300, "hot": 600}), (400, 32, {"bucket": 5000})):
        texts = corpus(length)
        docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, start string")
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed(docs, length, gram=gram, **limits).collect()}
        want = expected([(t or "").encode() for t in texts], length)
        assert got == {(i if i else None): w for i, w in enumerate(want)}
    assert suffix.removed(docs.limit(0)).count() == 0


def test_repeated_rows_repeat_each_other(spark):
    docs = spark.createDataFrame([(1, "c" * 10 + "d" * 500)] * 2 + [(2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix.removed(docs).collect()) == [(1, 510), (1, 510), (2, 0)]


def test_finer_anchors_of_hot_pieces(spark):
    """A passage shared by many texts that differ around it, with every limit small: anchors are cut again and again."""
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage, other = noise(90), noise(70)
    texts = [noise(40) + passage[rnd.randrange(12) :] + noise(rnd.randrange(40)) + other[: rnd.randrange(50, 71)] for _ in range(80)]
    texts += [noise(20) + passage + "z" * 30 for _ in range(3)] + [passage[20:85]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(expected([t.encode() for t in texts], 60)))
    for limits in ({"hot": 200, "bucket": 400}, {"hot": 0, "bucket": 400}, {}):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed(docs, 60, gram=12, **limits).collect()}
        assert got == want


def test_long_texts_at_the_usual_limits(spark):
    rnd = random.Random(11)
    noise = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    shared = noise(30_000)
    texts = ["b" * 40_000, shared, noise(500) + shared[:20_000] + noise(500) + shared[19_500:], "xy" * 10_000, noise(60_000)]
    texts += [noise(300) + shared[9000:9600] + noise(300) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed(docs).collect()}
    assert got == dict(enumerate(expected([t.encode() for t in texts], 400)))
