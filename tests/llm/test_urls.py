import datetime

from tidewater.llm import urls

D = datetime.date


def test_intervals_and_matches(spark):
    entries = spark.createDataFrame(
        [("a", "d:bad.org", "add", D(2024, 1, 10)), ("a", "d:bad.org", "remove", D(2024, 2, 1)), ("a", "d:bad.org", "add", D(2024, 3, 1)), ("b", "p:ok.org/x/y", "add", D(2024, 1, 1)), ("b", "d:tie.org", "add", D(2024, 1, 1)), ("b", "d:tie.org", "remove", D(2024, 1, 1)), ("c", None, "add", D(2024, 1, 1)), ("c", "d:org", "add", None)],
        "list_name string, pattern string, action string, effective date",
    )
    cases = [
        ("http://bad.org/", D(2024, 1, 9), 0),
        ("http://bad.org/", D(2024, 1, 10), 1),
        ("https://u:p@WWW.Bad.org.:80?q=1", D(2024, 1, 31), 1),
        ("http://bad.org", D(2024, 2, 1), 0),
        ("http://bad.org", D(2024, 3, 1), 1),
        ("http://notbad.org", D(2024, 3, 1), 0),
        ("http://ok.org/x//y/z?x#y", D(2024, 3, 1), 1),
        ("http://ok.org/x/yy", D(2024, 3, 1), 0),
        ("http://sub.ok.org/x/y", D(2024, 3, 1), 0),
        ("http://tie.org", D(2024, 3, 1), 0),
        ("bad.org", D(2024, 3, 1), 0),
        (None, D(2024, 3, 1), 0),
        ("http://bad.org", None, 0),
        ("http://bad.org/" + "a/" * 100_000, D(2024, 3, 1), 1),
        ("", D(2024, 3, 1), 0),
    ]
    rows = [(i, u, d, "x") for i, (u, d, _) in enumerate(cases)] + [(1, cases[1][0], cases[1][1], "y"), (None, cases[1][0], cases[1][1], "z")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date, pattern string")
    out = urls.evaluate(captures, entries).collect()
    assert len(out) == len(rows)
    want = {i: n for i, (_, _, n) in enumerate(cases)} | {None: 1}
    assert all(r.n_active == want[r.page_id] and r.blocked == (r.n_active > 0) for r in out)
    assert urls.evaluate(captures.limit(0), entries).count() == 0
    assert all(not r.blocked for r in urls.evaluate(captures, entries.limit(0)).collect())


def test_plan_is_native(spark):
    out = urls.demo(spark, spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_overlapping_lists(spark):
    """One pattern on several lists, and several patterns of one list, each with its own interval."""
    rows = [("b", "d:bad.org", "add", 1), ("a", "d:bad.org", "add", 10), ("b", "d:bad.org", "remove", 20), ("c", "d:sub.bad.org", "add", 5), ("c", "p:sub.bad.org/x", "add", 15), ("a", "d:bad.org", "add", 12)]
    entries = spark.createDataFrame([(n, p, a, D(2024, 1, d)) for n, p, a, d in rows], "list_name string, pattern string, action string, effective date")
    want = {1: (1, "b"), 4: (1, "b"), 5: (2, "b"), 10: (3, "a"), 15: (4, "a"), 19: (4, "a"), 20: (3, "a")}
    captures = spark.createDataFrame([(d, "http://sub.bad.org/x/y", D(2024, 1, d)) for d in want], "page_id long, url string, fetched_on date")
    assert {r.page_id: (r.n_active, r.first_list) for r in urls.evaluate(captures, entries).collect()} == want
