import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from tidewater.operators import fulltext
from tidewater.operators.chunking import WindowSplitter
from tidewater.operators.store import Conflict, MemoryStore, Store

NOTES = "id long, title string, content string, category_id long"
FIELDS = ("title", "content")


def postings(index):
    return sorted((r.term, r.doc_id, r.field, r.tf, tuple(r.positions)) for r in index.postings.collect()), sorted(map(tuple, index.stats.collect()))


def size(path):
    return sum(p.stat().st_size for p in pathlib.Path(path).rglob("*.parquet"))


@pytest.mark.parametrize("kind", ["disk", "memory"])
def test_index_follows_every_change(spark, tmp_path, kind):
    store = Store(spark, str(tmp_path / "s"), index=FIELDS) if kind == "disk" else MemoryStore(spark, index=FIELDS)
    store.MOST = 3
    store.create()
    fresh = lambda: postings(fulltext.build(store.table("notes"), dict.fromkeys(FIELDS), "id"))
    put = lambda *rows: store.put(spark.createDataFrame(list(rows), NOTES), WindowSplitter())
    put((1, "one", "alpha beta", None), (2, "two", "beta gamma", None), (3, "three", None, None))
    put((1, "one", "delta", None))
    assert postings(store.fulltext()) == fresh()
    assert [r.doc_id for r in fulltext.search(store.fulltext(), "delta OR alpha").collect()] == [1]
    store.remove(spark.createDataFrame([(2,), (99,)], "id long"))
    put((4, "", "épsilon alpha alpha", None))
    assert postings(store.fulltext()) == fresh() and len(store._versions("postings")) <= 3
    assert [r.doc_id for r in fulltext.search(store.fulltext(), "alpha").collect()] == [4]
    store.save({"notes": store.table("notes").where("id <> 4")})
    assert postings(store.fulltext()) == fresh()
    with pytest.raises(ValueError):
        MemoryStore(spark).fulltext()


def test_writes_follow_the_size_of_the_change(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), index=FIELDS)
    store.MOST = 3
    store.create()
    rows = spark.range(3000).select("id", F.concat(F.lit("title "), "id").alias("title"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(150)), lambda k: F.hex(F.xxhash64("id", k))), " ").alias("content"), F.lit(None).cast("long").alias("category_id"))
    at = F.current_timestamp()
    store.save({"notes": rows.withColumn("created_at", at).withColumn("updated_at", at)})
    base = size(tmp_path / "s" / "postings")
    for i in range(5):  # merged twice on the way, the base never
        before = size(tmp_path / "s" / "postings")
        store.put(spark.createDataFrame([(i, "t", "few words", None)], NOTES), WindowSplitter())
        assert size(tmp_path / "s" / "postings") - before < base / 50
    assert store.fulltext().postings.where("doc_id < 5").count() == 15
    versions = store._versions("postings")
    assert len(versions) <= 3 and size(tmp_path / "s" / "postings" / versions[0]) > base / 2
    store.vacuum()
    assert len(list((tmp_path / "s" / "COMMITS").glob("0*"))) == 1
    assert store.fulltext().stats.count() == 3000


def test_unique_against_stored_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    at = datetime.datetime(2024, 1, 1)
    merge = lambda i, name: store.merge({"categories": (spark.createDataFrame([(i, name, at)], "id long, name string, created_at timestamp"), spark.createDataFrame([(i,)], "id long"))})
    merge(1, "Python")
    before = store.state()
    with pytest.raises(ValueError, match="unique"):
        merge(2, "Python")
    assert store.state() == before
    merge(1, "Python")  # in its own place
    merge(2, "Java")
    with pytest.raises(ValueError, match="unique"):
        merge(1, "Java")
    assert sorted((r.id, r.name) for r in store.table("categories").collect()) == [(1, "Python"), (2, "Java")]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    one.create()
    seen = two.state()
    row = lambda i: spark.createDataFrame([(i, "t", "x", None, None, None)], one.schemas["notes"])
    key = lambda i: spark.createDataFrame([(i,)], "id long")
    one.merge({"notes": (row(1), key(1))})
    with pytest.raises(Conflict):
        two.merge({"notes": (row(2), key(2)), "note_tags": (None, spark.createDataFrame([(2,)], "note_id long"))}, seen)
    assert [r.id for r in one.table("notes").collect()] == [1]  # none of its tables moved
    two.merge({"notes": (row(2), key(2))})
    assert sorted(r.id for r in one.table("notes").collect()) == [1, 2]
    assert not list((tmp_path / "s" / "COMMITS").glob("new-*"))
