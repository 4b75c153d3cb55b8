import collections
import random
import re
import zlib

from tidewater.llm import variants
from tidewater.llm.variants import Settings

SCHEMA = "doc_id long, text string, rank long, word string, n int"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, s):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if s.every and h % s.every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= s.least_length and n >= s.least_count}
    out = {}
    for w, n in words.items():
        close = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        form = close[0] if close and words[close[0]] >= s.ratio * n else None
        out[w] = (form, n, len(close), words.get(form))
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        yield w, form, root, n, n_near, form_n


def check(spark, rows, settings):
    docs = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)
    got = [tuple(r) for r in variants.variants(docs, settings).collect()]
    want = list(brute(rows, settings))
    key = lambda r: r[0]
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


def test_equals_all_pairs(spark):
    r = random.Random(5)
    stems = ["colour", "color", "aaaaa", "aaaa", "éààéé", "ÉààÉé", "abcabc", "naïveté"]

    def word():
        w = list(r.choice(stems))
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w[i : i + r.choice([0, 1])] = r.choice(["", "a", "b", "é"])
        return "".join(w)

    rows = [(i if i % 50 else None, r.choice(" .,-1\n").join(word() for _ in range(60))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "12 34"), rows[3], rows[3]]
    got = check(spark, rows, Settings())
    assert any(r[2] != r[1] for r in got if r[1]) and max(r[4] for r in got) > 5
    check(spark, rows, Settings(least_length=1, least_count=1, every=3))


def test_long_runs_cost_in_proportion(spark):
    run = "ab" * 20_000
    rows = [(1, " ".join([run] * 8 + [run + "c"] * 4 + [run[:-1]] * 3)), (2, "x")]
    got = {len(r.word): r for r in variants.variants(spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA), Settings(every=0)).collect()}
    assert {k: (v.n, v.n_near, v.form_n) for k, v in got.items()} == {40_000: (8, 2, None), 40_001: (4, 1, 8), 39_999: (3, 1, 8)}
    assert got[40_001].root == run


def test_ties_go_to_the_first_in_code_point_order(spark):
    text = " ".join(w for w, n in (("banana", 3), ("bananb", 6), ("bananz", 6), ("ÿbanana", 6)) for _ in range(n))
    got = {r.word: r for r in variants.variants(spark.createDataFrame([(1, text, 0, "", 0)], SCHEMA), Settings(every=0)).collect()}
    assert got["banana"].form == "bananb" and got["banana"].n_near == 3
    assert got["bananb"].form is None and got["bananb"].n_near == 2


def test_empty_table_and_session(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert variants.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
