"""What several corpus operators share: tables, folds, checkpoints, bounded samples and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch that a task turns into Python's objects at a time, where it holds whole texts.
ROWS = 256
#: A word: a run of code points other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(folds), F.lit(0))


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder, and read again: its lineage ends there, and no executor's loss costs more than a read."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for tables in between: what spark.checkpoint.dir names. In local mode, where all is one machine, a temporary one stands in."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType, rows: int | None = None) -> DataFrame:
    """Applies make()'s function to each Arrow batch, or to slices of so many rows; make() runs once a task, so that it can set up models and tables there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in pieces(batches, rows) if rows else batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings, empty for null."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def plain(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the named columns, as doc_id, text and so on, so that further columns cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def one_each(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns of more, one row for each doc_id: that of the first text by hash; so a sample of ids bounds the rows."""
    first = F.struct(F.xxhash64("text"), "text", *more)
    return df.groupBy("doc_id").agg(F.min_by(F.struct("text", *more), first).alias("x")).select("doc_id", "x.*")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def named(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of df has it."""
    return name if name.lower() not in {c.lower() for c in df.columns} else fresh(df, name)[0]


def sampled_labels(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most bound labelled ids (doc_id, label), the first by a hash of the id: a small table of a proven size."""
    return labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna().dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
