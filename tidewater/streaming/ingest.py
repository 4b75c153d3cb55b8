"""Incremental ingest: a stream of notes into a store, idempotent on the note's id; and a queue of chunks to embed later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.chunking import TextSplitter
from tidewater.operators.embedding import Embedder, try_embed_column
from tidewater.operators.store import Store
from tidewater.sources.shared import written


def ingest(notes: DataFrame, store: Store, splitter: TextSplitter, embedder: Embedder, checkpoint: str, order_col: str = "updated_at") -> StreamingQuery:
    """Starts the stream. Each batch keeps the latest version of every id and saves it with its chunks; a batch that is
    run again saves the same rows. Of versions equally late a fixed one stays, whatever the order of rows."""

    def batch(df: DataFrame, _: int) -> None:
        if df.isEmpty():
            return
        latest = df.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy(F.desc_nulls_last(order_col), F.xxhash64(*df.columns), *[F.col(c).cast("string") for c in df.columns]))).where("_r = 1").drop("_r")
        store.put(latest, splitter, embedder)

    return notes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_jobs(pending: DataFrame, size: int, order: str = "id") -> DataFrame:
    """pending rows with job, the number of the group of `size` they are embedded in.

    Numbers come from counts of ranges, not from one window over all rows. The ranges are written once: drawn again,
    their bounds need not be the same, and counts would be of other ranges than the rows.
    """
    spark = pending.sparkSession
    ranged = written(pending.repartitionByRange(order).sortWithinPartitions(order), "jobs").withColumn("_part", F.col("_metadata.file_name"))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()  # a row per file; their names follow the ranges
    before, total = [], 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        before.append((r["_part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(before, "_part string, _before long")
    place = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1 + F.col("_before")
    return ranged.join(F.broadcast(offsets), "_part").withColumn("job", F.floor(place / size).cast("long")).drop("_part", "_before")  # a row per file


#: What becomes of a chunk, and of the job it is embedded in.
PENDING, SENT, READY, FAILED = "PENDING", "SENT", "READY", "FAILED"


class Queue:
    """Deferred embedding. Chunks without a vector wait (PENDING); `flush` groups them into jobs (SENT), `sync` embeds a
    job's chunks and marks them READY, or all of them FAILED. Search sees READY chunks only (`visible`).

    Nothing is kept but `chunks` (id, content, embedding, state, job), a table: a queue that is made of a stored one goes
    on where that one stopped, and a job that is run again does the same work.
    """

    def __init__(self, chunks: DataFrame):
        has = set(chunks.columns)
        state = F.col("state") if "state" in has else F.when(F.col("embedding").isNull(), PENDING).otherwise(READY)
        self.chunks = chunks.withColumns({"state": state, "job": F.col("job") if "job" in has else F.lit(None).cast("long")})

    def visible(self) -> DataFrame:
        return self.chunks.where(F.col("state") == READY)

    def states(self) -> DataFrame:
        """(state, n)"""
        return self.chunks.groupBy("state").agg(F.count("*").alias("n"))

    def jobs(self) -> DataFrame:
        """(job, state, n): a job has FAILED if a chunk of it has, else it is READY if all of it is."""
        counts = self.chunks.where("job is not null").groupBy("job").agg(F.count("*").alias("n"), F.count_if(F.col("state") == FAILED).alias("f"), F.count_if(F.col("state") == READY).alias("r"))
        return counts.select("job", F.when(F.col("f") > 0, FAILED).when(F.col("r") == F.col("n"), READY).otherwise(SENT).alias("state"), "n")

    def flush(self, size: int, retry: bool = False) -> Queue:
        """Waiting chunks (and failed ones, if retry) get jobs of `size` rows, numbered behind those there are."""
        waiting = F.col("state").isin(PENDING, FAILED) if retry else F.col("state") == PENDING
        last = self.chunks.agg(F.max("job")).first()[0]
        sent = batch_jobs(self.chunks.where(waiting).drop("job", "state"), size, "id")
        sent = sent.withColumns({"job": F.col("job") + F.lit(0 if last is None else last + 1), "state": F.lit(SENT)})
        return Queue(written(self.chunks.where(~waiting).unionByName(sent), "queue"))

    def sync(self, embedder: Embedder, text_col: str = "content") -> Queue:
        """All sent jobs embedded. A chunk that has no text, or whose batch the embedder refuses, fails its job."""
        sent = self.chunks.where(F.col("state") == SENT)
        done = written(sent.withColumn("embedding", try_embed_column(embedder, F.col(text_col))), "queue")
        failed = done.where("embedding is null").select(F.col("job").alias("_job")).distinct()
        done = done.join(failed, F.col("job") == F.col("_job"), "left")
        fails = F.col("_job").isNotNull()
        done = done.withColumns({"state": F.when(fails, FAILED).otherwise(READY), "embedding": F.when(~fails, F.col("embedding"))}).drop("_job")
        return Queue(written(self.chunks.where(F.col("state") != SENT).unionByName(done), "queue"))
