"""Helpers shared by the corpus operators: scratch tables, skew-safe joins and repeat filters."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A hot-group list that is broadcast has at most this many rows, whatever the input.
MAX_HOT = 2000
#: Upper bound of a broadcast bitmap, in bits (32 MB); more rows are gone through in ranges of their hashes.
MAX_BITS = 1 << 28


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); where that is unset, a temporary one in local mode and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(shared)
        shared = spark.sparkContext.getCheckpointDir()
    return shared.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Batches of at most ``rows`` rows for the Python stages that are run inside, whose rows are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def released(run):
    """A task's generator that gives freed memory back to the system at its end, since Python workers are kept for later tasks."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a GNU extension
            if trim:
                trim(0)

    return task


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, spread: Column) -> DataFrame:
    """Left join of ``rows`` with one row per key in ``groups``, safe when a key holds a large share of the rows.

    ``size`` counts the rows of a key, so at most n_rows / threshold keys pass the threshold: that
    list is broadcast. Rows it serves get a key of their own (``spread``) for the shuffled join.
    """
    threshold = max(1000, n_rows // MAX_HOT)
    values = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) > threshold).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = groups.filter(F.col(size) <= threshold).select(F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    out = out.withColumn("_probe", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread))
    out = out.join(cold, F.col("_probe") == F.col("_cold_key"), "left")
    pick = [F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in values]
    return out.select(*rows.columns, *pick)


def _slots(h: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(h, F.lit(5)), F.lit(bits)), F.pmod(F.xxhash64(h, F.lit(7)), F.lit(bits))]


def by_ranges(rows: DataFrame, h: Column, n_rows: int) -> list[DataFrame]:
    """The rows in parts by hash, so many that a filter of each part's rows has its 16 bits a row; one part needs no copy.

    The parts are folders of one table, written without a shuffle, so that each row is read once more whatever their number.
    """
    ranges = -(-16 * n_rows // MAX_BITS)
    if ranges <= 1:
        return [rows]
    path = f"{scratch_dir(rows.sparkSession)}/ranges-{uuid.uuid4().hex}"
    marked = rows.withColumn("_range", F.pmod(h, F.lit(ranges)).cast("int"))
    marked.write.partitionBy("_range").parquet(path)
    table = rows.sparkSession.read.schema(marked.schema).parquet(path)
    return [table.filter(F.col("_range") == r).drop("_range") for r in range(ranges)]


def filter_bits(n_rows: int) -> int:
    """Size of a filter: 16 bits a row, a power of two, never above MAX_BITS."""
    return min(MAX_BITS, max(1 << 16, 1 << (16 * max(1, n_rows) - 1).bit_length()))


def bitmap(keys: DataFrame, h: Column, bits: int, at_least: int) -> DataFrame:
    """Bloom filter with two hash functions as a table (bucket, map): slots that ``at_least`` keys set."""
    slots = keys.select(F.explode(F.array(*_slots(h, bits))).alias("slot"))
    slots = slots.groupBy("slot").count().filter(F.col("count") >= at_least)
    bit = F.col("slot").bitwiseAND(F.lit(32767))
    return slots.groupBy(F.shiftright("slot", 15).alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("map"))


def flag_by_bitmap(rows: DataFrame, h: Column, maps: DataFrame, bits: int, flag: str) -> DataFrame:
    """Add boolean ``flag``: false only if the key is surely not in the filter. The filter is at most MAX_BITS, so it is broadcast."""
    out, names = rows.withColumns({f"_s{i}": s for i, s in enumerate(_slots(h, bits))}), []
    for i in range(2):
        slot = F.col(f"_s{i}")
        m = F.broadcast(maps.select(F.col("bucket").alias(f"_b{i}"), F.col("map").alias(f"_m{i}")))
        out = out.join(m, F.shiftright(slot, 15) == F.col(f"_b{i}"), "left")
        byte = F.substring(F.col(f"_m{i}"), F.shiftright(slot.bitwiseAND(F.lit(32767)), 3).cast("int") + 1, F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        names.append(F.coalesce(F.call_function("getbit", value, slot.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False)))
    return out.withColumn(flag, names[0] & names[1]).select(*rows.columns, flag)


def split_by_keys(rows: DataFrame, keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be in ``keys`` and rows whose key surely is not, without shuffling ``rows``."""
    bits = filter_bits(n_keys)
    maps = bitmap(keys, F.xxhash64(key), bits, 1)
    flagged = flag_by_bitmap(rows, F.xxhash64(key), maps, bits, "_maybe")
    return flagged.filter("_maybe").drop("_maybe"), flagged.filter(~F.col("_maybe")).drop("_maybe")


def without_keys(rows: DataFrame, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """Rows whose key is not in ``keys``; only those that the filter cannot clear are shuffled."""
    maybe, surely_not = split_by_keys(rows, keys, key, n_keys)
    return surely_not.unionByName(maybe.join(keys, key, "left_anti").select(rows.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
