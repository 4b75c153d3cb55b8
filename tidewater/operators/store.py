"""Maintenance of tables: upserts, replacement of chunks, cascading deletes, checks; and a store of versions on disk.

Changes are sets of rows: anti-joins and unions. A store's table is a folder of versions; a change writes versions of all
tables it touches and then one commit that lists them, so readers see whole changes.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import context_text, vector_text
from tidewater.operators.chunking import TextSplitter, chunk
from tidewater.operators.embedding import Embedder, embed_column
from tidewater.operators.fulltext import Index, build, dealt
from tidewater.sources.schemas import CASCADES, INDEX, TABLES, UNIQUE
from tidewater.sources.shared import written


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows take the place of the table's rows with the same keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(rows)


def delete(table: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose column is among the keys of `gone` go."""
    return table.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(*table.columns)


def delete_cascade(tables: dict[str, DataFrame], name: str, gone: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """All tables without the rows of `name` in `gone` and whatever hangs on them."""
    out = dict(tables)
    lost = {name: out[name].join(gone.select(key).distinct(), key, "left_semi")}
    out[name] = delete(out[name], gone, key, key)
    for child, column, parent in CASCADES:
        if parent in lost and child in out:
            dead = out[child].join(lost[parent].select(F.col("id").alias(column)).distinct(), column, "left_semi")
            lost[child] = lost[child].unionByName(dead) if child in lost else dead
            out[child] = delete(out[child], lost[parent], column, "id")
    return out


def violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def make_chunks(notes: DataFrame, categories: DataFrame | None, splitter: TextSplitter, embedder: Embedder | None) -> DataFrame:
    """Chunk rows of notes, embedded with their context. The id is a function of note and index, so it is stable."""
    parts = chunk(notes, "id", "content", splitter).withColumnRenamed("id", "note_id")
    named = notes.select(F.col("id").alias("note_id"), "title", "category_id")
    if categories is not None:
        named = named.join(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")), "category_id", "left")
    else:
        named = named.withColumn("category", F.lit(None).cast("string"))
    rows = parts.join(named, "note_id").withColumn("text", vector_text(context_text(F.col("category"), F.col("title")), F.col("content")))
    rows = rows.withColumn("id", F.xxhash64("note_id", "chunk_index")).withColumn("created_at", F.current_timestamp())
    vector = embed_column(embedder, F.col("text")) if embedder is not None else F.lit(None).cast("array<float>")
    return rows.withColumn("embedding", vector).select(*TABLES["note_chunks"].names)


def changed_notes(tables: dict[str, DataFrame], notes: DataFrame, splitter: TextSplitter, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of notes, and of their chunks, that saving `notes` makes: missing contents keep the stored ones; notes
    without content have no chunks; updated_at moves."""
    stored = tables["notes"].select("id", *[F.col(c).alias(f"_{c}") for c in ("title", "content", "category_id", "created_at")])
    value = lambda c: F.coalesce(F.col(c), F.col(f"_{c}")) if c in notes.columns else F.col(f"_{c}")
    rows = notes.join(stored, "id", "left").select("id", value("title").alias("title"), value("content").alias("content"), value("category_id").alias("category_id"), F.coalesce("_created_at", F.current_timestamp()).alias("created_at"), F.current_timestamp().alias("updated_at"))
    return rows, make_chunks(rows.where("content <> ''"), tables.get("categories"), splitter, embedder)


def save_notes(tables: dict[str, DataFrame], notes: DataFrame, splitter: TextSplitter, embedder: Embedder | None = None) -> dict[str, DataFrame]:
    """The tables with notes created or updated and their chunks and vectors replaced."""
    rows, chunks = changed_notes(tables, notes, splitter, embedder)
    out = dict(tables)
    out["notes"] = upsert(tables["notes"], rows, ["id"])
    out["note_chunks"] = delete(tables["note_chunks"], rows, "note_id", "id").unionByName(chunks)
    return out


def sql(tables: dict[str, DataFrame], statement: str, params: list | None = None) -> DataFrame:
    """A statement over the tables by their names, with `?` bound to params in order."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement, args=params or [])


def new_content(notes: DataFrame, stored: DataFrame, column: str = "content") -> DataFrame:
    """Notes whose content no stored note has, one of each: the least id."""
    own = notes.withColumn("_sha", F.sha2(column, 256))
    first = own.groupBy("_sha").agg(F.min("id").alias("id"))
    seen = stored.select(F.sha2(column, 256).alias("_sha")).distinct()
    return own.join(first, ["_sha", "id"], "left_semi").join(seen, "_sha", "left_anti").drop("_sha")


class Conflict(RuntimeError):
    """Another writer has changed the store since this one read it."""


class State(NamedTuple):
    """What a store holds at one moment: the number of its last commit, and each table's versions."""

    n: int
    lists: dict[str, list[str]]


class Store:
    """Tables under a root path. A table is a list of versions: a whole one, then changes (rows, and the keys they replace).

    A commit is one file that lists the versions of all tables, named by its number. It appears by a rename that fails if
    the number is taken, so a change of several tables is seen as a whole or not at all, and of two writers who read the
    same state one gets a Conflict and can try again.

    `save` writes whole tables, `merge` changes, which cost what the change is worth. When a list has more than MOST
    versions, the last ones are merged as long as what they hold is at least half of the one before, so large versions
    are seldom written again. `vacuum` removes what the last commit doesn't list.

    index: columns of notes to keep a full-text index of. Its postings and lengths are two more tables, in the same
    commits as the notes: a change writes the postings of the notes that it changes.
    """

    MOST = 8

    def __init__(self, spark: SparkSession, root: str, dimension: int = 64, index: tuple[str, ...] = ()):
        self.spark, self.root, self.dimension, self.index = spark, root, dimension, tuple(index)
        self.schemas = TABLES | (INDEX if index else {})

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[str]:
        path, fs = self._fs(f"{self.root}/COMMITS")
        return sorted(n for f in (fs.listStatus(path) if fs.exists(path) else []) if (n := f.getPath().getName()).isdigit())

    def state(self) -> State:
        names = self._commits()
        if not names:
            return State(0, {})
        path, fs = self._fs(f"{self.root}/COMMITS/{names[-1]}")
        stream = fs.open(path)
        try:
            return State(int(names[-1]), json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def _commit(self, at: State, lists: dict[str, list[str]]) -> None:
        """The state after `at`; Conflict if there is one already."""
        target, fs = self._fs(f"{self.root}/COMMITS/{at.n + 1:012d}")
        new = self._fs(f"{self.root}/COMMITS/new-{uuid.uuid4().hex}")[0]
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(at.lists | lists).encode()))
        stream.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, target, none)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                raise Conflict(f"commit {at.n + 1} is another writer's") from None
            raise

    def _versions(self, name: str) -> list[str]:
        return self.state().lists.get(name, [])

    def create(self) -> None:
        """Empty tables where there are none; does nothing the second time."""
        there = self.state().lists
        if missing := {k: self.spark.createDataFrame([], s) for k, s in self.schemas.items() if k not in there}:
            self.save(missing)

    def _change(self, name: str, version: str) -> tuple[DataFrame, DataFrame]:
        at = f"{self.root}/{name}/{version}"
        return self.spark.read.schema(self.schemas[name]).parquet(f"{at}/rows"), self.spark.read.parquet(f"{at}/gone")

    def _replaced(self, name: str, rows: DataFrame, versions: list[str]) -> DataFrame:
        for version in versions:
            new, gone = self._change(name, version)
            rows = rows.join(gone, gone.columns, "left_anti").select(*self.schemas[name].names).unionByName(new)
        return rows

    def table(self, name: str, at: State | None = None) -> DataFrame:
        first, *changes = (at or self.state()).lists[name]
        return self._replaced(name, self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}/{first}"), changes)

    def tables(self, at: State | None = None) -> dict[str, DataFrame]:
        at = at or self.state()
        return {k: self.table(k, at) for k in TABLES}

    def fulltext(self) -> Index:
        """The index of the notes as they are."""
        if not self.index:
            raise ValueError("the store keeps no index")
        at = self.state()
        return Index(self.table("postings", at), self.table("doc_stats", at), self.index)

    def _indexed(self, rows: DataFrame | None, gone: DataFrame) -> dict[str, tuple[DataFrame | None, DataFrame]]:
        """The changes of the index that go with a change of notes."""
        if not self.index:
            return {}
        made = None if rows is None else build(rows, dict.fromkeys(self.index), "id")
        key = gone.select(F.col("id").alias("doc_id"))
        return {"postings": (made and made.dealt(), key), "doc_stats": (made and made.stats, key)}

    def is_empty(self) -> bool:
        return self.table("notes").isEmpty() or self.table("note_chunks").isEmpty()

    def sql(self, statement: str, params: list | None = None) -> DataFrame:
        return sql(self.tables(), statement, params)

    def seed(self, load: Callable[[], dict[str, DataFrame]]) -> dict[str, int]:
        """Where notes or chunks are empty, all tables are cleared and loaded; else nothing changes. Rows of each table."""
        if self.is_empty():
            loaded = load()
            self.save({k: loaded.get(k, self.spark.createDataFrame([], s)) for k, s in TABLES.items()})
        return {k: df.count() for k, df in self.tables().items()}

    def _checked(self, name: str, df: DataFrame) -> DataFrame:
        if name == "note_chunks":
            size = F.size("embedding")
            ok = F.col("embedding").isNull() | (size == self.dimension)
            df = df.withColumn("embedding", F.when(ok, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors must have {self.dimension} dimensions")).cast("array<float>")))
        return df.select(*self.schemas[name].names)

    def _write(self, name: str, df: DataFrame, path: str, ready: bool = False) -> None:
        (dealt(df) if name == "postings" and not ready else df).write.parquet(path)

    def _unique(self, name: str, rows: DataFrame, stored: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """What must be unique is so among the rows, and between them and the stored rows that stay."""
        if name not in UNIQUE:
            return
        keys = UNIQUE[name]
        clash = not violations(rows, keys).isEmpty()
        if not clash and stored is not None:
            # rows that replace all stored ones with their key can't clash with any
            fresh = rows.join(gone, gone.columns, "left_anti") if set(gone.columns) <= set(keys) else rows
            stay = stored.join(gone, gone.columns, "left_anti").select(*keys)
            clash = not fresh.isEmpty() and not fresh.join(stay, keys, "left_semi").isEmpty()
        if clash:
            raise ValueError(f"{name}: {keys} must be unique")

    def save(self, tables: dict[str, DataFrame]) -> None:
        """Writes whole versions, checks unique keys and vector lengths, then commits them all. A failure before that
        leaves all as it was. With notes, their index is written whole."""
        at, lists = self.state(), {}
        if ready := bool(self.index) and "notes" in tables and "postings" not in tables:
            made = build(tables["notes"], dict.fromkeys(self.index), "id")
            tables = tables | {"postings": made.dealt(), "doc_stats": made.stats}
        for name, df in tables.items():
            lists[name] = [uuid.uuid4().hex]
            path = f"{self.root}/{name}/{lists[name][0]}"
            self._write(name, self._checked(name, df), path, ready)
            self._unique(name, self.spark.read.schema(self.schemas[name]).parquet(path))
        self._commit(at, lists)

    def merge(self, changes: dict[str, tuple[DataFrame | None, DataFrame]], at: State | None = None, ready: bool = False) -> None:
        """Of each table the rows to add (None: none) and the keys, by column, of the rows that they take the place of.

        at: the state that the changes were made from; Conflict if it is no longer the last. What is unique must be so
        among the rows added, and between them and the stored rows that stay. ready: postings are dealt already.
        """
        at, lists = at or self.state(), {}
        for name, (rows, gone) in changes.items():
            version = uuid.uuid4().hex
            lists[name] = [*at.lists[name], version]
            rows = self.spark.createDataFrame([], self.schemas[name]) if rows is None else rows
            self._write(name, self._checked(name, rows), f"{self.root}/{name}/{version}/rows", ready)
            gone.distinct().write.parquet(f"{self.root}/{name}/{version}/gone")
            self._unique(name, self._change(name, version)[0], self.table(name, at), self._change(name, version)[1])
        self._commit(at, lists)
        self._tidy([name for name in lists if len(lists[name]) > self.MOST])

    def _tidy(self, names: list[str]) -> None:
        """Merges the last versions of tables that have too many."""
        at, lists = self.state(), {}
        for name in names:
            versions = at.lists[name]
            sizes = [fs.getContentSummary(path).getLength() for path, fs in (self._fs(f"{self.root}/{name}/{v}") for v in versions)]
            first, total = len(versions) - 1, sizes[-1]
            while first > 0 and (first > len(versions) - 2 or sizes[first - 1] <= 2 * total):
                first -= 1
                total += sizes[first]
            new = uuid.uuid4().hex
            keys = {tuple(self._change(name, v)[1].columns) for v in versions[max(1, first) :]}
            if first == 0 or len(keys) > 1:
                first = 0
                self._write(name, self.table(name, at), f"{self.root}/{name}/{new}")
            else:
                rows = self._replaced(name, self._change(name, versions[first])[0], versions[first + 1 :])
                self._write(name, rows, f"{self.root}/{name}/{new}/rows")
                gone = reduce(DataFrame.union, [self._change(name, v)[1] for v in versions[first:]])
                gone.distinct().write.parquet(f"{self.root}/{name}/{new}/gone")
            lists[name] = [*versions[:first], new]
        if lists:
            with contextlib.suppress(Conflict):  # then the next change tidies up
                self._commit(at, lists)

    def put(self, notes: DataFrame, splitter: TextSplitter, embedder: Embedder | None = None) -> None:
        """Creates or updates notes with their chunks, vectors and postings."""
        at = self.state()
        rows = written(changed_notes(self.tables(at), notes, splitter, embedder)[0], "notes")
        chunks = make_chunks(rows.where("content <> ''"), self.table("categories", at), splitter, embedder)
        gone = rows.select("id")
        self.merge({"notes": (rows, gone), "note_chunks": (chunks, rows.select(F.col("id").alias("note_id"))), **self._indexed(rows, gone)}, at, ready=True)

    def remove(self, ids: list[int] | DataFrame) -> int:
        """Notes go with their chunks, vectors, tags and postings; how many there were. ids: a list or a table (id)."""
        at = self.state()
        stored = self.table("notes", at).select("id")
        dead = stored.join(ids.select("id").distinct(), "id", "left_semi") if isinstance(ids, DataFrame) else stored.where(F.col("id").isin(*ids) if ids else F.lit(False))
        gone = written(dead, "gone")
        n = gone.count()
        if n:
            key = gone.select(F.col("id").alias("note_id"))
            self.merge({"notes": (None, gone), "note_chunks": (None, key), "note_tags": (None, key), **self._indexed(None, gone)}, at)
        return n

    def vacuum(self) -> None:
        """Removes versions and commits that the last commit doesn't list. Readers and writers of older ones must be done."""
        at = self.state()
        for folder, kept in [("COMMITS", {f"{at.n:012d}"}), *((name, {*at.lists.get(name, [])}) for name in self.schemas)]:
            path, fs = self._fs(f"{self.root}/{folder}")
            for f in fs.listStatus(path) if fs.exists(path) else []:
                if f.getPath().getName() not in kept:
                    fs.delete(f.getPath(), True)

    def drop(self) -> None:
        path, fs = self._fs(self.root)
        fs.delete(path, True)


class MemoryStore(Store):
    """The same over DataFrames in memory, for tests and small collections."""

    def __init__(self, spark: SparkSession, dimension: int = 64, index: tuple[str, ...] = ()):
        super().__init__(spark, "", dimension, index)
        self.held: dict[str, DataFrame] = {}

    def state(self) -> State:
        return State(0, {name: ["held"] for name in self.held})

    def table(self, name: str, at: State | None = None) -> DataFrame:
        return self.held[name]

    def save(self, tables: dict[str, DataFrame]) -> None:
        if self.index and "notes" in tables and "postings" not in tables:
            made = build(tables["notes"], dict.fromkeys(self.index), "id")
            tables = tables | {"postings": made.postings, "doc_stats": made.stats}
        new = {name: self.spark.createDataFrame(self._checked(name, df).collect(), self.schemas[name]) for name, df in tables.items()}  # small by contract
        for name, df in new.items():
            self._unique(name, df)
        self.held.update(new)

    def merge(self, changes: dict[str, tuple[DataFrame | None, DataFrame]], at: State | None = None, ready: bool = False) -> None:
        out = {}
        for name, (rows, gone) in changes.items():
            kept = self.table(name).join(gone.distinct(), gone.columns, "left_anti").select(*self.schemas[name].names)
            out[name] = kept if rows is None else kept.unionByName(rows.select(*self.schemas[name].names))
        self.save(out)

    def vacuum(self) -> None:
        pass

    def drop(self) -> None:
        self.held.clear()
