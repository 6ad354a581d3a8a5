"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from replog.plans.scale import written


def read_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file_id, line_number (from 0), byte_offset, split and body of every line of text files.

    Lines are numbered inside each split of a file; how many lines and bytes the splits before it hold is a prefix sum over a table of splits.
    So one large file is numbered by as many tasks as it has splits. Invalid UTF-8 is replaced."""
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("_seq"), F.col("value")
    )
    size = F.octet_length("value").cast("long") + 1
    at = W.partitionBy("file_id", "split").orderBy("_seq")
    local = raw.withColumns({"_n": F.row_number().over(at).cast("long") - 1, "_b": F.sum(size).over(at) - size})
    per = raw.groupBy("file_id", "split").agg(F.count("*").alias("_rows"), F.sum(size).alias("_bytes"))
    before = W.partitionBy("file_id").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    carry = per.select("file_id", "split", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_r0"), F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_b0"))
    joined = local.join(carry, ["file_id", "split"])
    body = F.regexp_replace(F.make_valid_utf8("value"), "\r$", "")
    return joined.select("file_id", (F.col("_r0") + F.col("_n")).alias("line_number"), (F.col("_b0") + F.col("_b")).alias("byte_offset"), "split", body.alias("body"))


def register_files(lines: DataFrame) -> DataFrame:
    """One row a file: lines, bytes of text, first and last timestamp, status."""
    return lines.groupBy("file_id").agg((F.max("line_number") + 1).alias("line_count"), F.sum(F.octet_length("body") + 1).alias("size_bytes"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), F.lit("ready").alias("status"))


def line_index(lines: DataFrame, step: int = 500) -> DataFrame:
    """Every step-th line that is not blank, with its time."""
    return lines.filter((F.col("line_number") % step == 0) & (F.trim("body") != "")).select("file_id", "line_number", "timestamp")


def write_facts(facts: DataFrame, path: str) -> None:
    """Replaces the rows of the files that facts has; a second run leaves the same rows."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(path)


def read_facts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Facts kept below path, with their fingerprint; none where nothing is kept yet."""
    full = StructType([*[f for f in schema.fields if f.name != "file_id"], StructField("fingerprint", StringType()), schema["file_id"]])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def refresh_facts(lines: DataFrame, versions: DataFrame, path: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Facts (file_id, ...) of the files of versions (file_id, fingerprint), made by make from lines: only files whose fingerprint is not kept below path are worked out, and their
    partitions alone are replaced; the others are read. Files without facts are kept as a row of nulls, so that they too are worked out once.

    A file's partition is written whole, by one commit of the job; a run that dies before leaves the old ones."""
    spark = lines.sparkSession
    schema = make(lines.limit(0)).schema
    ids = versions.select("file_id", F.col("fingerprint").alias("_now"))
    kept = read_facts(spark, path, schema)
    marks = kept.select("file_id", "fingerprint").distinct()
    stale = ids.join(marks, (ids["file_id"] == marks["file_id"]) & (ids["_now"] == marks["fingerprint"]), "left_anti")
    todo = written(stale)
    if todo.limit(1).count():
        own = make(lines.join(todo.select("file_id"), "file_id", "left_semi")).withColumn("_some", F.lit(True))
        fresh = todo.join(own, "file_id", "left").withColumn("fingerprint", F.col("_now")).drop("_now", "_some")
        fresh.select(*[f.name for f in schema.fields if f.name != "file_id"], "fingerprint", "file_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(path)
    now = read_facts(spark, path, schema)
    found = now.join(ids.withColumnRenamed("file_id", "_id"), (F.col("file_id") == F.col("_id")) & (F.col("fingerprint") == F.col("_now"))).drop("_id", "_now", "fingerprint")
    others = [f.name for f in schema.fields if f.name != "file_id"]
    return found.select(*schema.names).filter(" or ".join(f"`{c}` is not null" for c in others))


def file_version(files: DataFrame, version: str) -> DataFrame:
    """files with a fingerprint of what their facts were derived from."""
    return files.withColumn("fingerprint", F.sha2(F.concat_ws("|", F.lit(version), "file_id", "line_count", "size_bytes"), 256))


def stale_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files of new whose fingerprint old does not have."""
    return new.join(old.select("file_id", "fingerprint"), ["file_id", "fingerprint"], "left_anti")


def export_matches(lines: DataFrame) -> DataFrame:
    """`Line n: text`, lines counted from 1, in order."""
    return lines.select("file_id", "line_number", F.concat(F.lit("Line "), F.col("line_number") + 1, F.lit(": "), F.col("body")).alias("value"))


def export_feedback_csv(feedback: DataFrame, path: str, columns: Sequence[str], newest: str = "created_at") -> None:
    """Feedback rows as CSV with a header, newest first."""
    feedback.orderBy(F.desc(newest)).select(*columns).write.mode("overwrite").csv(path, header=True)


def read_release_cache(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a release-notes cache, a row each."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")


def read_markdown_dir(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files below a folder; the title is the front matter's, else the first heading, else the file's name."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    one = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    title = F.coalesce(one(r"(?s)^---\n.*?\ntitle:\s*([^\n]+?)\s*\n.*?---"), one(r"(?m)^#\s+(.+?)\s*$"), F.regexp_extract("path", r"([^/]+)\.(?:md|markdown)$", 1))
    return raw.withColumn("title", title)


def concat_task_logs(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of a task's files as one sequence, numbered in the order of files (task, file_id, file_order), and whether the task's name changed with the file."""
    order = W.partitionBy("task").orderBy("file_order")
    sized = files.join(lines.groupBy("file_id").agg((F.max("line_number") + 1).alias("_n")), "file_id")
    start = F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("_start", start)
    return lines.join(placed.select("file_id", "task", "file_order", "_start"), "file_id").withColumn("global_line", F.col("_start") + F.col("line_number")).drop("_start")
