import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.functions import vectors as vx
from tidewater.operators.chunking import WindowSplitter
from tidewater.operators.embedding import HashingEmbedder, QueryCache, embed_query
from tidewater.operators.store import MemoryStore, Store, delete_cascade, save_notes
from tidewater.sources.files import read_notes
from tidewater.streaming.ingest import Queue, batch_jobs, ingest


def saved(spark, store, rows, schema="id long, title string, content string, category_id long"):
    tables = save_notes(store.tables(), spark.createDataFrame(rows, schema), WindowSplitter(), HashingEmbedder())
    store.save({k: tables[k] for k in ("notes", "note_chunks")})


def test_life_of_a_note(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    store.create()
    assert store.is_empty()
    at = datetime.datetime(2024, 1, 1)
    store.save({"categories": spark.createDataFrame([(1, "c", at)], "id long, name string, created_at timestamp")})
    saved(spark, store, [(1, "One", "x " * 900, 1), (2, "Two", "", None), (3, "Three", "y", 1)])
    chunks = store.table("note_chunks")
    assert {r.note_id: r.n for r in chunks.groupBy("note_id").agg(F.count("*").alias("n")).collect()} == {1: 2, 3: 1}
    assert chunks.where("size(embedding) <> 64").count() == 0
    # an update replaces chunks and vectors; content that isn't given stays
    saved(spark, store, [(1, "One!")], "id long, title string")
    assert store.table("note_chunks").where("note_id = 1").count() == 2
    saved(spark, store, [(1, "tiny")], "id long, content string")
    note = store.table("notes").where("id = 1").first()
    assert (note.title, note.content) == ("One!", "tiny") and note.updated_at >= note.created_at
    assert store.table("note_chunks").where("note_id = 1").count() == 1
    left = delete_cascade(store.tables(), "categories", store.table("categories"))
    assert {k: left[k].count() for k in ("categories", "notes", "note_chunks")} == {"categories": 0, "notes": 1, "note_chunks": 0}
    with pytest.raises(ValueError):
        store.save({"categories": spark.createDataFrame([(1, "c", at), (2, "c", at)], "id long, name string, created_at timestamp")})
    assert store.table("categories").count() == 1
    store.drop()


def test_files(spark, tmp_path):
    (tmp_path / "00_my_first-note.md").write_text("# Привет\nx")
    (tmp_path / "other.txt").write_text("no")
    assert [tuple(r) for r in read_notes(spark, f"{tmp_path}/*.md").collect()] == [("00 My First-Note", "# Привет\nx")]


def test_stream_is_idempotent(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "id long, title string, content string, category_id long, updated_at timestamp"
    t = lambda d: datetime.datetime(2024, 1, d)
    spark.createDataFrame([(1, "a", "old", None, t(1)), (1, "a", "new", None, t(2)), (2, "b", "z", None, t(1))], schema).write.parquet(src)
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    for log in ("one", "two"):  # the second run sees everything again
        ingest(spark.readStream.schema(schema).parquet(src), store, WindowSplitter(), HashingEmbedder(), str(tmp_path / log)).awaitTermination()
        assert {r.id: r.content for r in store.table("notes").collect()} == {1: "new", 2: "z"}
        assert store.table("note_chunks").count() == 2


@pytest.mark.parametrize("kind", ["disk", "memory"])
def test_changes_cost_what_they_change(spark, tmp_path, kind):
    store = Store(spark, str(tmp_path / "s")) if kind == "disk" else MemoryStore(spark)
    store.MOST = 3
    store.create()
    notes = "id long, title string, content string, category_id long"
    split, embed = WindowSplitter(), HashingEmbedder()
    store.put(spark.createDataFrame([(i, f"t{i}", f"text {i}", None) for i in range(6)], notes), split, embed)
    for i in range(4):  # beyond MOST: written whole again
        store.put(spark.createDataFrame([(i, f"new {i}", "word " * 500, None)], notes), split, embed)
    assert {r.id: r.title for r in store.table("notes").collect()} == {0: "new 0", 1: "new 1", 2: "new 2", 3: "new 3", 4: "t4", 5: "t5"}
    assert {r.note_id: r["count"] for r in store.table("note_chunks").groupBy("note_id").count().collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1, 5: 1}
    assert store.remove([0, 5, 99]) == 2 and store.remove([99]) == 0 and store.remove([]) == 0
    assert sorted(r.id for r in store.table("notes").collect()) == [1, 2, 3, 4]
    assert sorted({r.note_id for r in store.table("note_chunks").collect()}) == [1, 2, 3, 4]
    before = sorted(map(tuple, store.table("notes").collect()))
    if kind == "disk":
        assert len(store._versions("notes")) <= 3
        store.vacuum()
        assert len([p for p in (tmp_path / "s" / "notes").iterdir() if p.is_dir()]) == len(store._versions("notes"))
    assert sorted(map(tuple, store.table("notes").collect())) == before
    with pytest.raises(Exception, match="dimensions"):
        store.put(spark.createDataFrame([(7, "t", "x", None)], notes), split, HashingEmbedder(8))
    assert store.table("notes").count() == 4
    store.drop()


def test_seed_and_sql(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    at = datetime.datetime(2024, 1, 1)
    calls = []

    def load():
        calls.append(1)
        notes = spark.createDataFrame([(1, "a", "x", None, at, at), (2, "b", "y", None, at, at)], store.table("notes").schema)
        chunks = spark.createDataFrame([(10, 1, 0, "x", at, None)], store.table("note_chunks").schema)
        return {"notes": notes, "note_chunks": chunks}

    want = {"categories": 0, "tags": 0, "notes": 2, "note_chunks": 1, "note_tags": 0}
    assert store.seed(load) == want and store.seed(load) == want and calls == [1]
    rows = store.sql("SELECT n.id FROM notes n JOIN note_chunks c ON c.note_id = n.id WHERE n.title = ? AND c.chunk_index < ?", ["a", 5]).collect()
    assert [r.id for r in rows] == [1]


def test_jobs(spark):
    out = batch_jobs(spark.range(100), 30).groupBy("job").count().orderBy("job").collect()
    assert [r["count"] for r in out] == [30, 30, 30, 10]


def test_jobs_of_many_partitions(spark):
    """A million rows in no order over many partitions: every job is whole, and they follow the order."""
    rows = spark.range(0, 1_000_000, 1, 40).select(F.expr("pmod(id * 7919, 1000000)").alias("id"))
    out = batch_jobs(rows, 30).groupBy("job").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    assert out.count() == 33_334
    assert out.where("n <> 30 OR low <> job * 30 OR high <> job * 30 + 29").collect() == [(33_333, 10, 999_990, 999_999)]


class Picky(HashingEmbedder):
    def embed(self, texts, task="document"):
        if any("bad" in t for t in texts):
            raise OSError("refused")
        return super().embed(texts, task)


def test_queue(spark):
    rows = [(i, "bad" if i == 65 else f"text {i}", None) for i in range(100)] + [(200, "has one", [1.0] * 64)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    queue = Queue(spark.createDataFrame(rows, "id long, content string, embedding array<float>"))
    assert {r.state: r.n for r in queue.states().collect()} == {"PENDING": 100, "READY": 1}
    assert [r.id for r in queue.visible().collect()] == [200]
    sent = queue.flush(30)
    assert sorted((r.job, r.state, r.n) for r in sent.jobs().collect()) == [(0, "SENT", 30), (1, "SENT", 30), (2, "SENT", 30), (3, "SENT", 10)]
    assert sent.visible().count() == 1
    done = sent.sync(Picky())
    jobs = {r.job: r.state for r in done.jobs().collect()}
    assert jobs[2] == "FAILED" and set(jobs.values()) <= {"READY", "FAILED"}
    failed = sum(r.n for r in done.jobs().collect() if r.state == "FAILED")
    assert done.visible().count() == 101 - failed
    again = done.flush(30, retry=True).sync(HashingEmbedder())
    assert again.visible().count() == 101 and again.chunks.where("embedding is null").count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_queries_are_embedded_once():
    seen = []

    class Counting(HashingEmbedder):
        def embed(self, texts, task="document"):
            seen.append((tuple(texts), task))
            return super().embed(texts, task)

    cache = QueryCache(Counting())
    assert (embed_query(cache, "a b") == embed_query(cache, "a b")).all() and seen == [(("a b",), "query")]
    cache.embed(["a b"], "document")
    assert seen[-1] == (("a b",), "document")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    q = vx.literal([3.0, 4.0])
    out = df.select(vx.cosine_distance("v", q).alias("c"), vx.l1_distance("v", q).alias("l1"), vx.l2_distance("v", q).alias("l2"), vx.normalize("v").alias("n"), vx.from_blob(vx.to_blob("v")).alias("b"), "v").collect()
    assert (out[0].c, out[0].l1, out[0].l2) == (pytest.approx(0), 0, 0) and out[0].n == pytest.approx([0.6, 0.8])
    assert out[1].c is None and out[1].n == [0.0, 0.0] and all(r.b == r.v for r in out)
