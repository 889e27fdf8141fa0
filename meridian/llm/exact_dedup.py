"""Exact duplicates by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 hashes every text and finds the filter slots that two or more rows set; pass 2 tests each row
against that filter. A row with a slot of its own is unique and passes straight through; the others,
which hold all true repeats and a few false alarms, are grouped by SHA-256. A filter has 16 bits a row at every
size: rows beyond what one broadcast filter serves are gone through in ranges of their hashes, each with its own.

Defined cases: null text counts as empty text and equals it; null doc_id never wins against a number;
of rows alike in text and doc_id exactly one is kept; long texts are hashed whole; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, by_ranges, filter_bits, flag_by_bitmap, join_groups, materialize

def _sha(docs: DataFrame):
    return F.sha2(F.coalesce(docs["text"], F.lit("")), 256).alias("text_sha256")


def _flag(digests: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    n = digests.count()
    bits = filter_bits(n)
    maps = materialize(bitmap(digests, F.xxhash64("text_sha256"), bits, 2), "repeat-filter")
    return flag_by_bitmap(digests, F.xxhash64("text_sha256"), maps, bits, "maybe"), maps, bits, n


def _groups(digests: DataFrame) -> DataFrame:
    flagged, _, _, n = _flag(digests)
    straight = flagged.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = materialize(flagged.filter("maybe").drop("maybe"), "maybe-repeated")
    groups = materialize(maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    spread = F.concat(F.lit("#"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    joined = join_groups(maybe, groups, "text_sha256", "group_size", n, spread)
    turn = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("keep_id"))
    kept = (F.col("turn") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    shuffled = joined.withColumn("turn", turn).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    return straight.unionByName(shuffled)


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = materialize(docs.select("doc_id", _sha(docs)), "digests")
    parts = by_ranges(digests, F.xxhash64("text_sha256"), digests.count())
    return reduce(DataFrame.unionByName, map(_groups, parts))


def _distinct(rows: DataFrame) -> DataFrame:
    digests = materialize(rows.select("doc_id", "text_sha256"), "digests")
    flagged, maps, bits, _ = _flag(digests)
    keep = flagged.filter("maybe").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id")).withColumnRenamed("text_sha256", "keep_sha")
    rows = flag_by_bitmap(rows, F.xxhash64("text_sha256"), maps, bits, "maybe")
    same = (F.col("text_sha256") == F.col("keep_sha")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    chosen = rows.filter("maybe").join(keep, same, "left_semi").dropDuplicates(["text_sha256", "doc_id"])
    return rows.filter(~F.col("maybe")).select("row.*").unionByName(chosen.select("row.*"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without repeats: unique ones pass straight through, only possible repeats are shuffled."""
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"].alias("doc_id"), _sha(docs))
    parts = by_ranges(rows, F.xxhash64("text_sha256"), docs.count())
    return reduce(DataFrame.unionByName, map(_distinct, parts))
