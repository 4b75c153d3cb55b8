"""The store's tables as schemas; field names of the data model."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _table(**columns) -> StructType:
    return StructType([StructField(k, v, k != "id") for k, v in columns.items()])


L, S, T = LongType(), StringType(), TimestampType()
TABLES = {
    "categories": _table(id=L, name=S, created_at=T),
    "tags": _table(id=L, name=S, created_at=T),
    "notes": _table(id=L, title=S, content=S, category_id=L, created_at=T, updated_at=T),
    "note_chunks": _table(id=L, note_id=L, chunk_index=IntegerType(), content=S, created_at=T, embedding=ArrayType(FloatType())),
    "note_tags": _table(note_id=L, tag_id=L, created_at=T),
}
#: Of a store that keeps a full-text index of its notes.
INDEX = {
    "postings": StructType().add("term", S).add("doc_id", L).add("field", S).add("tf", IntegerType()).add("positions", ArrayType(IntegerType())),
    "doc_stats": StructType().add("doc_id", L).add("doc_len", IntegerType()),
}
UNIQUE = {"categories": ["name"], "tags": ["name"], "note_chunks": ["note_id", "chunk_index"], "note_tags": ["note_id", "tag_id"]}
#: child table, its column, parent table: rows go with their parent.
CASCADES = [("notes", "category_id", "categories"), ("note_chunks", "note_id", "notes"), ("note_tags", "note_id", "notes"), ("note_tags", "tag_id", "tags")]
