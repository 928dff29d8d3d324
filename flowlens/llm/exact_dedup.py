"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._base import SPACE_RE, cut, may_be_in


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """``doc_id, n_chars, norm, len, head, raw`` of each row: the text without white space, its length, hashes of its beginning and of the original."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.regexp_replace(text, f"{SPACE_RE}+", "").alias("norm"), F.xxhash64(text).alias("raw"))
    return rows.withColumns({"len": F.length("norm"), "head": F.xxhash64(F.substring("norm", 1, prefix_chars))})


def _refined(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digest_all: bool) -> DataFrame:
    """``doc_id, n_chars, raw, again, text_sha256``: only rows that may have a copy are ``again``, and only they, or all, have the full hash.

    No text is shuffled. Lengths and prefix hashes are counted, which aggregates before it shuffles; those that occur
    twice become a filter of bounded size, and whatever passes it is hashed where it is read.
    """
    rows = _fingerprints(docs, id_col, text_col, prefix_chars)
    full = F.sha2("norm", 256).alias("text_sha256")
    prints = cut(rows.select("doc_id", "n_chars", "raw", "len", "head", *([full] if digest_all else [])), "prints")
    lengths = cut(prints.groupBy("len").count().where("count > 1").select(F.xxhash64("len").alias("h")), "lengths")
    near = may_be_in(prints.select("len", "head"), F.xxhash64("len"), lengths, "near").where("near")
    heads = cut(near.groupBy("len", "head").count().where("count > 1").select(F.xxhash64("len", "head").alias("h")), "heads")
    if digest_all:
        return may_be_in(prints, F.xxhash64("len", "head"), heads, "again").select("doc_id", "n_chars", "raw", "again", "text_sha256")
    read = may_be_in(rows, F.xxhash64("len", "head"), heads, "again")
    return cut(read.select("doc_id", "n_chars", "raw", "again", F.when(F.col("again"), full).alias("text_sha256")), "exact")


def _groups(hashed: DataFrame) -> DataFrame:
    """``text_sha256, best, keep_id, group_size`` of each text that may have copies."""
    # ~id falls as the id rises and cannot overflow; nulls are least, so they lose.
    order = F.struct(F.col("n_chars"), F.bitwise_not("doc_id").alias("inv"), F.col("raw"))
    groups = hashed.where("again").groupBy("text_sha256").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("text_sha256", "best", F.bitwise_not(F.col("best.inv")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """Which rows of ``docs`` repeat another row's text, compared without white space ``[\\x20\\x09-\\x0D]``.

    Texts are refined in three steps. Only texts whose normalised length occurs twice go on to the hash of their
    first ``prefix_chars`` characters, only those whose (length, prefix hash) occurs twice are read in full and
    hashed with SHA-256. All steps aggregate before they shuffle, so that a group holding a third of all rows arrives
    as a few partial counts; its rows then meet its result in a skewed join, which Spark splits.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row for each input row. Of equal texts, the one
    with the most code points in its original form stays, then the smallest id. ``text_sha256`` is null for rows
    that needed no full hash, unless ``digest_all``.

    Null texts count as empty, all empty texts are one group. Rows that repeat an id are one document: they share
    one fate, and group_size counts rows. A null id loses ties, and a group of null ids only has a null keep_id and
    is kept. An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    hashed = _refined(docs, id_col, text_col, prefix_chars, digest_all)
    many = hashed.where("again").join(_groups(hashed), "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    one = hashed.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    return many.unionByName(one).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """``docs`` with exactly one row of each text (as :func:`exact_dedup` compares and chooses), all columns as they were.

    Of rows that share an id, those with other texts are judged by their own; of rows alike in id and text one stays,
    also where the id is null. Only rows that may go are shuffled.
    """
    hashed = _refined(docs, id_col, text_col, prefix_chars, False)
    judged = hashed.where("again").join(_groups(hashed), "text_sha256")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("best.n_chars")) & (F.col("raw") == F.col("best.raw"))
    # Rows alike in id and text; of those that stay only repeated ones matter.
    alike = judged.groupBy(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw")).agg(F.min(best).alias("__stays"), F.count(F.lit(1)).alias("__rows"))
    doubtful = cut(alike.where("not __stays or __rows > 1"), "doubtful")
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    split = may_be_in(docs.withColumn("__raw", key), F.xxhash64(F.col(id_col), F.col("__raw")), doubtful.select(F.xxhash64("__id", "__raw").alias("h")), "__near")
    near = split.where("__near").withColumn("__key", F.col("__raw")).drop("__raw", "__near")
    gone = doubtful.where("not __stays").select("__id", "__raw")
    stay = near.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__raw")), "left_anti")
    return split.where("not __near").select(*docs.columns).unionByName(stay.dropDuplicates([id_col, "__key"]).select(*docs.columns))
