"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Characters of the contract's white space class ``[\x20\x09-\x0D]``, which is what ``bytes.split()`` splits at.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; a folder of our own only where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = f"file://{tempfile.mkdtemp(prefix='flowlens-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, costs one write."""
    return written(df, name)[0]


def written(df: DataFrame, name: str = "t", *by: str) -> tuple[DataFrame, str]:
    """As :func:`cut`, with the path; a folder for each value of ``by``. What was shuffled for it is deleted once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/flowlens/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the columns named in ``more``; whatever else ``docs`` holds is left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def n_words(text) -> F.Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a string column: starts of words are where a word character follows a space or nothing."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD_RE))).cast("long")


def may_be_in(rows: DataFrame, key, wanted: DataFrame, out: str, most_bits: int = 1 << 26) -> DataFrame:
    """Add boolean ``out``: true for all rows whose ``key`` (a long hash) is in the one column of ``wanted``, and for few others.

    ``wanted`` should be written already, as it is read twice. Its hashes set bits of a map with about 16 bits for each,
    but never more than ``most_bits``, so that what is broadcast is bounded (2^20 rows of two longs). Beyond that more
    rows that aren't wanted pass: the filter spares work and decides nothing.
    """
    h = wanted.columns[0]
    bits = min(most_bits, 1 << max(16, (16 * wanted.count()).bit_length()))
    word = lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(bits // 64 - 1)
    bit = lambda x: x.bitwiseAND(63).cast("int")
    keyed = wanted.where(F.col(h).isNotNull()).select(word(F.col(h)).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col(h))).alias("__bit"))
    words = keyed.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    joined = rows.withColumn("__key", key).withColumn("__at", word(F.col("__key"))).join(F.broadcast(words), F.col("__at") == F.col("__word"), "left")
    hit = F.call_function("shiftrightunsigned", F.coalesce("__bits", F.lit(0).cast("long")), bit(F.col("__key"))).bitwiseAND(F.lit(1).cast("long")) == 1
    return joined.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__key", "__at", "__word", "__bits")


def running_start(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in ascending ``key`` (null keys first, ties by the other columns).

    Rows are range partitioned and sorted, each partition keeps a running sum, and the partitions' totals (one
    row for each partition) give the offsets: two narrow passes, and no task sees more than its own range.
    """
    cols = df.columns
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, F.col(key)).sortWithinPartitions(key, *[c for c in cols if c != key])
    schema = ranged.select("*", F.lit(0).alias("__part"), F.lit(0).cast("long").alias("__run")).schema

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(b.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(v)
            before = int(ends[-1]) if len(v) else before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(ends - v)], names=[*b.schema.names, "__part", "__run"])

    runs = cut(ranged.mapInArrow(run, schema), "runs")
    # One row for each partition of the range exchange: bounded by spark.sql.shuffle.partitions.
    totals = runs.groupBy("__part").agg(F.sum(value).alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    return runs.join(F.broadcast(offsets), "__part").select(*cols, (F.col("__run") + F.col("__offset")).cast("long").alias(out))
