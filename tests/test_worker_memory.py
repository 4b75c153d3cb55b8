import numpy as np
from pyspark.sql import functions as F

from tidewater.operators.chunking import PARCEL, WindowSplitter, chunk, parcels
from tidewater.operators.embedding import SLICE, embed_column, try_embed_column


class Few:
    """Refuses more texts at once than a worker should hand over."""

    dimension = 1

    def embed(self, texts, task="document"):
        if len(texts) > SLICE:
            raise ValueError("too many texts")
        return np.array([[float(t[1:])] for t in texts], np.float32)


def test_an_embedder_gets_slices_of_a_batch(spark):
    rows = spark.range(0, 3 * SLICE + 7, 1, 1).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("v"), "id")).alias("t"))
    for embed in (embed_column, try_embed_column):
        got = {r.id: r.v for r in rows.select("id", embed(Few(), F.col("t")).alias("v")).collect()}
        assert got == {i: [float(i)] if i % 5 else None for i in range(3 * SLICE + 7)}


def test_parcels_are_bounded_by_characters():
    made = [(0, i, 0, 0, None, False, "x" * (PARCEL // 3)) for i in range(10)] + [(0, 10, 0, 0, None, True, "y" * 5 * PARCEL)]
    parts = list(parcels(iter(made)))
    assert [r for p in parts for r in p] == made and max(map(len, parts)) == 3 and len(parts) == 4


def test_ids_keep_their_type_and_chunks_their_order(spark):
    docs = spark.range(3).select(F.expr("DATE '2024-01-01' + CAST(id AS INT)").alias("doc_id"), F.when(F.col("id") < 2, F.repeat(F.lit("ab\n"), 2000)).alias("text"))
    out = chunk(docs)
    assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    got = [(c.chunk_index, c.start, c.end, c.cut_type, c.is_last, c.content) for c in out.where("doc_id = '2024-01-02'").orderBy("chunk_index").collect()]
    assert got == [(c.index, c.start, c.end, c.cut_type, c.is_last, c.text) for c in WindowSplitter().split_text("ab\n" * 2000)]
    assert out.select("doc_id").distinct().count() == 2
