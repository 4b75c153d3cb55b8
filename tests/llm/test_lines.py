from collections import defaultdict

from tidewater.llm import lines


def plain(rows, least):
    """(doc_id, text, source) -> texts, in order."""
    sites, first = defaultdict(set), {}
    key = lambda line: " ".join(w.decode() for w in line.encode().split())
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        for p, line in enumerate((rows[i][1] or "").split("\n")):
            if key(line):
                if rows[i][2] is not None:
                    sites[key(line)].add(rows[i][2])
                first.setdefault(key(line), (i, p))
    out = []
    for i, (_, text, _) in enumerate(rows):
        kept = [x for p, x in enumerate((text or "").split("\n")) if not key(x) or len(sites[key(x)]) < least or first[key(x)] == (i, p)]
        out.append(None if text is None else "\n".join(kept))
    return out


def test_matches_brute_force(spark):
    rows = [(None, "all rights\nnull id", "s1"), (0, None, "s2"), (1, "", None), (2, "\n \n", "s1"), (3, "a" * 300_000 + "\nshared 0", "s1")]
    for i in range(4, 70):
        body = [f"own {i}", "  all \t rights", f"shared {i % 5}", f"shared {i % 5}", f"rare {i // 9}", "", "x" * (i % 3)]
        rows.append((i, "\n".join(body), None if i % 17 == 0 else f"s{i % 23}"))
    docs = spark.createDataFrame([(a, b, c, len(b or ""), 1, 2) for a, b, c in rows], "doc_id long, text string, source string, n_chars long, h1 int, removed int")
    for least in (2, 9, 10, 12):
        got = {r.doc_id: r for r in lines.drop_boilerplate(docs, min_sites=least).collect()}
        for (i, text, _), want in zip(rows, plain(rows, least), strict=True):
            assert got[i].text == want, (least, i)
            assert got[i].n_chars == len(want or "") and (got[i].h1, got[i].removed) == (1, 2)
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0
    assert lines.drop_boilerplate(docs).columns == docs.columns


def test_repeated_rows_are_alike(spark):
    docs = spark.createDataFrame([(1, "x y", f"s{i}") for i in range(12)] + [(2, "x y", "s1")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.text) for r in lines.drop_boilerplate(docs).collect()) == [(1, "x y")] * 12 + [(2, "")]
