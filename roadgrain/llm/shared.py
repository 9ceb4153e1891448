"""Helpers that several operators use: scratch tables, whole-text batches, word patterns."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.sources import sinks

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Rows that reach a Python worker at once. Rows hold whole texts or long lists, and a batch is held in
#: full by the executor, outside its heap, and by the worker.
ARROW_ROWS = 1_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str, *, order_within: list[str] | None = None) -> DataFrame:
    """Write the frame to a new table in the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks it ran, not the steps before.
    """
    if order_within:
        df = df.sortWithinPartitions(*order_within)
    with small_batches(df.sparkSession):
        return sinks.materialise(df, scratch_path(df.sparkSession, name))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Hand at most ``ARROW_ROWS`` rows at once to Python meanwhile; then the session is as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    least = ARROW_ROWS if int(before) <= 0 else min(int(before), ARROW_ROWS)  # 0 or less: no limit
    spark.conf.set(name, str(least))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared scratch folder."""
    return f"{sinks.scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo 5; fold 0 is held out. NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def picked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and text_hash, which tells apart rows that repeat an id; no other column is read."""
    text = df[text_col].cast("string")
    return df.select(df[id_col].cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def without(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` that no (doc_id, text_hash) row of ``gone`` names."""
    named = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = df[id_col].eqNullSafe(named["__id"]) & (F.xxhash64(df[text_col].cast("string")) == named["__hash"])
    return df.join(named, same, "left_anti")


def text_rows(batches: Iterable[pa.RecordBatch], key: str, text: str) -> Iterator[tuple[object, str]]:
    """(key, text) of each row, null texts as empty, one batch in memory at a time."""
    for batch in batches:
        for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
            yield k, t or ""


class Rows:
    """Collect tuples and hand them out as record batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 4096, most_bytes: int = 16 << 20) -> None:
        self.schema, self.most, self.most_bytes = schema, most, most_bytes
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, *row: object, size: int = 0) -> bool:
        """Append one row; true when the batch is full. ``size``: bytes of the row's long fields."""
        self.rows.append(row)
        self.bytes += size
        return len(self.rows) >= self.most or self.bytes >= self.most_bytes

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [() for _ in self.schema]
        self.rows, self.bytes = [], 0
        return pa.record_batch(
            [pa.array(list(c), type=f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema
        )
