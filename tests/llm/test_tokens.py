import random

import pyarrow as pa

from tidewater.llm.common import byte_words
from tidewater.llm.tokens import hashed_words


def test_words_and_hashes_follow_byte_words():
    rnd = random.Random(1)
    texts = ["", None, " ", "a", "A b\tC", "x" * 100_000 + " y", "é É z", "\0 \0\0 a\0", "ab\x0bcd\x0cef\r\n gh", "12345678 123456789 12345678\0"]
    texts += ["".join(rnd.choice("aAbB \n\té") for _ in range(rnd.randrange(60))) for _ in range(500)]
    for batch in (pa.array(texts), pa.array(["q w", *texts]).slice(1), pa.array(texts, pa.large_string()), pa.array([None, ""]), pa.array([], pa.string())):
        hashes, counts = hashed_words(batch)
        words = [byte_words(t) for t in batch.to_pylist()]
        assert counts.tolist() == [len(w) for w in words]
        of = {}
        for word, h in zip((w for ws in words for w in ws), hashes.tolist(), strict=True):
            assert of.setdefault(word, h) == h
        assert len(set(of.values())) == len(of)
