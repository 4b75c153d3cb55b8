import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import suffix


def counted(texts, words):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    return [len({j for i in range(len(w) - words + 1) if seen[tuple(w[i : i + words])] > 1 for j in range(i, i + words)}) for w in split]


@given(st.lists(st.lists(st.sampled_from([0, 1, 70_000]), max_size=30), min_size=1, max_size=8), st.integers(1, 15))
@settings(max_examples=300, deadline=None)
def test_expansion_of_numbers_is_brute_force(texts, length):
    seen = Counter(tuple(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    want = [[i for i in range(len(t) - length + 1) if seen[tuple(t[i : i + length])] > 1] for t in texts]
    assert [x.tolist() for x in suffix.repeats([np.array(t, np.int64) for t in texts], length)] == want


def test_short_passages_are_counted_and_stay(spark):
    """Passages of over 50 words with fewer than 400 bytes repeat across documents; nothing else does."""
    rnd = random.Random(4)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(4, 7))) for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    texts = [f"{prose(80)} {passages[i % 4]} {prose(70)}" for i in range(20)] + [prose(200) for _ in range(20)] + [prose(90) + " " + passages[0][: -len(passages[0].split()[-1])] + prose(3), None, "", "\t \n"]
    assert all(51 < len(p.split()) and len(p) < 400 for p in passages)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_repeated_words, r.n_removed) for r in suffix.removed(docs).collect()}
    assert got == {i: (n, 0) for i, n in enumerate(counted(texts, suffix.WORDS))}
    assert [got[i][0] for i in (0, 20, 40)] == [60, 0, 59]


def test_words_match_brute_force_at_any_limits(spark):
    """Blanks differ between copies, words repeat within a text, and anchors are cut again and again."""
    rnd = random.Random(8)
    noise = lambda n: [rnd.choice(["a", "bé", "c,", "\0d", "e"]) for _ in range(n)]
    line, other = noise(30), noise(20)
    glued = lambda words: "".join(w + rnd.choice([" ", "\n", "\t ", "\r\n"]) for w in words)
    texts = [glued(noise(rnd.randrange(12)) + line[rnd.randrange(9) :] + noise(rnd.randrange(9)) + other[: rnd.randrange(8, 21)]) for _ in range(70)]
    texts += [glued(line), glued(line + line), "a " * 40, "z", None, " \n", texts[0], " ".join(line)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(counted(texts, 14)))
    for limits in ({}, {"hot": 100, "bucket": 300}, {"hot": 0, "bucket": 300}):
        got = {r.doc_id: r.n_repeated_words for r in suffix.removed(docs, words=14, word_gram=4, **limits).collect()}
        assert got == want
