"""Files as notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import title_of
from tidewater.operators.chunking import TextSplitter, WindowSplitter, chunk
from tidewater.operators.code import CodeSplitter
from tidewater.operators.markdown import MarkdownBlockSplitter

#: Which splitter a file's kind calls for.
SPLITTERS: dict[str, TextSplitter] = {"md": MarkdownBlockSplitter(least=0), "markdown": MarkdownBlockSplitter(least=0), "txt": WindowSplitter(), "py": CodeSplitter()}


def read_notes(spark: SparkSession, glob: str) -> DataFrame:
    """(title, content), one row per file, whole files as UTF-8; order by title where order matters."""
    return spark.read.text(glob, wholetext=True).select(title_of(F.col("_metadata.file_name")).alias("title"), F.col("value").alias("content"))


def chunk_files(spark: SparkSession, folder: str, splitters: dict[str, TextSplitter] | None = None) -> DataFrame:
    """(path, title, the columns of chunks, metadata as JSON) of all files of the given kinds, each split as its kind calls for."""
    kinds = splitters or SPLITTERS
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{" + ",".join(kinds) + "}", recursiveFileLookup=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), title_of(F.col("_metadata.file_name")).alias("title"), F.col("value").alias("text"))
    parts = []
    for kind, splitter in kinds.items():
        made = chunk(files.where(F.col("path").endswith(f".{kind}")), "path", "text", splitter)
        parts.append(made.withColumn("metadata", F.to_json("metadata") if hasattr(splitter, "METADATA") else F.lit(None).cast("string")))
    return reduce(DataFrame.union, parts).join(files.select("path", "title"), "path")
