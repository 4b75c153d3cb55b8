import base64
import functools
import hashlib
import itertools

import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


@functools.cache
def ranks():
    with open(PATH, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(100_000)
def merged(piece):
    """Ids of one pre-token: of all adjacent pairs whose join has a rank, the least one is joined, first place first."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        least, at = min((ranks().get(a + b, 1 << 60), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
        if least == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks()[p] for p in parts]


def plain_bpe(text):
    return [i for m in regex.findall(public_tokenizers.PATTERN, text or "") for i in merged(m.encode())]


@given(st.text(st.sampled_from("ab'slré \n\t1,.日́\xa0🙂"), max_size=200), st.integers(1, 40), st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_chunks_are_whole_encoding(text, chunk, overlap):
    assert bpe.encode_chunked(text, PATH, chunk, overlap) == bpe.encode_text(text, PATH) == plain_bpe(text)


def test_documents(spark):
    words = " ".join(f"word{i}'s  été\n" for i in range(4000))
    texts = [None, "", " ", "hello", words, words, "a" * 1500, " " * 1200 + "x", "<|endoftext|>", "日本語 🙂"]
    docs = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)] + [(4, words, "y", 2)], "doc_id long, text string, ids string, k int")
    for chunk, overlap in ((1000, 50), (1 << 15, 1 << 10)):
        got = sorted(map(tuple, bpe.encode(docs, PATH, chunk, overlap).drop("ids").collect()), key=str)
        want = []
        for i, t in [*((i if i else None, t) for i, t in enumerate(texts)), (4, words)]:
            ids = plain_bpe(t)
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert bpe.decode(bpe.packed(bpe.encode_text(words, PATH)), PATH).decode() == words
