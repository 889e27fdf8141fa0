"""Removal of every byte covered by a 200-byte string that also starts anywhere else in the corpus.

Spark brings equal strings together, a suffix order in each shard finds them:

1. Every 200-byte string has an anchor: the leftmost least hash among its 32-byte grams, which depends on its
   content alone, so equal strings have equal anchors. A run of strings with one anchor is a unit.
2. Only units whose anchor's gram occurs again can hold a repeated string; the others end here. Units of a hot gram are cut
   into parts by how far their strings start before it, an eighth of the ways each, and go by a hash of the bytes that
   all strings of the part have, which equal strings share: so a gram with many contexts is many groups.
3. Units are dealt into shards by gram, equal units once with their number. Where a gram has several units, their suffixes are
   put in order with their common prefixes by external induced sorting (``suffixes``). A string
   is repeated if it shares 200 bytes with a neighbour in that order, or its unit occurs again.
4. The runs found go back to their documents, which are cut as judged on the input.

Defined cases: null text is empty; texts shorter than 200 bytes lose nothing; rows that repeat a doc_id are
texts of their own and repeat each other if equal; an empty table gives an empty result. A gram is a
64-bit hash: a collision only brings units together that then differ. A unit is known by two 64-bit hashes; a text of any length is read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_groups, materialize, split_by_keys
from .suffixes import suffix_order

LENGTH, GRAM = 200, 32
#: Bytes of units that a shard should hold, and tuples of its sort that stay in memory.
SHARD_BYTES, HELD = 4_000_000, 4_000_000
#: Units of a gram above which they are cut and dealt by more of their bytes.
HOT_GRAM = 10_000
_POSITION = np.uint64((1 << 28) - 1)
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 22


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each gram, by sums of powers that slide over the bytes."""
    n = len(data) - gram + 1
    power = np.full(len(data) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    inverse = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=total[1:])
    h = (total[gram:] - total[:n]) * np.cumprod(inverse)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first string, last string) of each run of strings with one anchor."""
    if len(text) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = []
    for a in range(0, len(text) - length + 1, _BLOCK):  # blocks overlap by a string, so runs are only cut
        data = np.frombuffer(text, np.uint8, min(_BLOCK + length - 1, len(text) - a), a)
        h = gram_hashes(data, gram)
        least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        width, step = length - gram + 1, 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[: len(data) - length + 1], least[width - step : width - step + len(data) - length + 1])
        at = (least & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        parts.append((h[at[first]], first + a, last + a))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _arrays(columns, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def find_anchors(base: DataFrame, length: int, gram: int) -> DataFrame:
    """gram, row, first, last of every unit."""

    def run(batches):
        for batch in batches:
            found, size = [], 0
            rows = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1)):
                g, first, last = anchors(text.as_py().encode(), length, gram)
                found.append((g.view(np.int64), np.full(len(g), rows[i]), first, last))
                size += len(g)
                if size > 500_000 or i + 1 == len(rows):
                    yield _arrays([np.concatenate(c) for c in zip(*found, strict=True)], ["gram", "row", "first", "last"], [pa.int64()] * 4)
                    found, size = [], 0

    return base.select("row", "text").mapInArrow(run, "gram long, row long, first long, last long")


def _narrow(gram: int, first: int, last: int, unit: bytes, length: int, width: int):
    """Parts of a hot gram's unit, by where its strings hold the gram, keyed by the bytes that all strings of the part have: (key, first, unit)."""
    data = np.frombuffer(unit, np.uint8)
    h = gram_hashes(data[:length], width) & ~_POSITION
    lead = int(h.argmin())  # strings start at most this far before the gram
    step = max(1, (length - width + 1) // 8)
    for n in range(max(0, lead - (last - first)) // step, lead // step + 1):
        a, b = max(0, lead - (n + 1) * step + 1), min(last - first, lead - n * step)
        same = unit[max(0, lead - n * step) : lead - (n + 1) * step + 1 + length]
        key = hashlib.blake2b(same, digest_size=8, key=b"%d %d" % (gram, n)).digest()
        yield int.from_bytes(key, "little", signed=True), first + a, unit[a : b + length]


def cut_units(base: DataFrame, hits: DataFrame, length: int, gram: int) -> DataFrame:
    """gram, row, first, unit (bytes) of the given runs of each row; runs of hot grams in narrower parts."""
    names, types = ["gram", "row", "first", "unit"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            out, size = ([], [], [], []), 0
            for row, text, runs in zip(*batch.columns, strict=True):
                data, row = text.as_py().encode(), row.as_py()
                for r in runs.as_py():
                    unit = data[r["first"] : r["last"] + length]
                    parts = _narrow(r["gram"], r["first"], r["last"], unit, length, gram) if r["hot"] else [(r["gram"], r["first"], unit)]
                    for key, first, unit in parts:
                        for c, v in zip(out, (key, row, first, unit), strict=True):
                            c.append(v)
                        size += len(unit)
                if size > 8_000_000:
                    yield _arrays(out, names, types)
                    out, size = ([], [], [], []), 0
            yield _arrays(out, names, types)

    runs = hits.groupBy("row").agg(F.collect_list(F.struct("gram", "first", "last", "hot")).alias("runs"))
    runs = materialize(runs, "unit-runs")
    maybe, _ = split_by_keys(base.select("row", "text"), runs.select("row"), "row", runs.count())
    return maybe.join(runs, "row").select("row", "text", "runs").mapInArrow(run, "gram long, row long, first long, unit binary")


def _mark_shard(length: int, held: int):
    """The repeated strings of a shard's units, as runs (a, b) of their offsets. Units that are alone with their gram are repeated only if they occur again."""

    def run(batches):
        parts = list(batches)
        if not sum(map(len, parts)):
            return
        parts = pa.Table.from_batches(parts).combine_chunks()
        single = parts.column("n").to_numpy() == 1
        _, of, together = np.unique(parts.column("gram").to_numpy(), return_inverse=True, return_counts=True)
        sizes = pc.binary_length(parts.column("unit")).to_numpy().astype(np.int64)
        runs = [None if one else [0, int(n) - length] for one, n in zip(single, sizes, strict=True)]
        mixed = np.flatnonzero(together[of] > 1)
        if len(mixed):
            size = sizes[mixed]
            starts = np.cumsum(size + 1) - size - 1
            text = np.frombuffer(b"\0".join(parts.column("unit").take(pa.array(mixed)).to_pylist()) + b"\0", np.uint8).astype(np.int16) + 1
            text[starts + size] = 0
            order, shared = suffix_order(text, length, held)
            again = np.zeros(len(text), bool)
            hit = np.flatnonzero(shared >= length)
            again[order[hit]] = again[order[hit - 1]] = True
            for k, start, n in zip(mixed.tolist(), starts.tolist(), size.tolist(), strict=True):
                if single[k]:
                    edge = np.flatnonzero(np.diff(np.r_[False, again[start : start + n - length + 1], False]))
                    runs[k] = (edge - np.tile([0, 1], len(edge) // 2)).tolist() or None
        marked = pa.array([k for k, r in enumerate(runs) if r], pa.int64())
        out = parts.select(["x", "y"]).take(marked).append_column("marks", pa.array([r for r in runs if r], pa.list_(pa.int32())))
        yield from out.combine_chunks().to_batches()

    return run


def removed_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_GRAM, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """The rows (row, doc_id, text) and, for rows that lose bytes, their removed runs (start, end) as pieces."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = materialize(find_anchors(base, length, gram), "anchors")
    repeated = materialize(found.groupBy("gram").agg(F.count("*").alias("times")).filter("times > 1"), "repeated-grams")
    hits = join_groups(found, repeated, "gram", "times", found.count(), F.xxhash64("row", "first")).filter("times IS NOT NULL").withColumn("hot", F.col("times") > hot)
    # two hashes of the bytes are a unit's identity
    units = cut_units(base, hits, length, gram).withColumn("unit_key", F.struct(F.xxhash64("gram", "unit").alias("x"), F.xxhash64(F.lit(1), "unit", "gram").alias("y")))
    units = materialize(units, "units")
    discard(found, repeated)
    distinct = units.groupBy("gram", "unit_key", "unit").agg(F.count("*").alias("n"))
    size = units.agg(F.coalesce(F.sum(F.octet_length("unit")), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    dealt = distinct.repartition(shards, "gram").select("gram", "unit_key.x", "unit_key.y", "unit", "n")
    marks = dealt.mapInArrow(_mark_shard(length, held), "x long, y long, marks array<int>").select(F.struct("x", "y").alias("unit_key"), "marks")
    marks = materialize(marks, "marks")
    counts = units.groupBy("unit_key").agg(F.count("*").alias("n"))
    marks = materialize(marks.join(counts, "unit_key"), "marks-counted")
    spread = F.struct(F.xxhash64("row", "first", F.lit(1)).alias("x"), F.lit(0).cast("long").alias("y"))
    placed = join_groups(units.select("unit_key", "row", "first"), marks, "unit_key", "n", units.count(), spread).filter("marks IS NOT NULL")
    runs = placed.groupBy("row").agg(F.collect_list(F.struct("first", "marks")).alias("pieces"))
    return base, materialize(runs, "removed-runs")


def _cut(length: int):
    names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()]

    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            pieces = batch.column(2)
            inner = pieces.flatten()
            marks, first = inner.field("marks"), inner.field("first").to_numpy()
            pairs = marks.flatten().to_numpy().reshape(-1, 2)
            per_piece = pc.list_value_length(marks).to_numpy() // 2
            ends = np.r_[0, np.cumsum(per_piece)][np.r_[0, np.cumsum(pc.list_value_length(pieces).to_numpy())]]
            pairs = pairs + np.repeat(first, per_piece)[:, None]
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                data = text.as_py().encode()
                mine = pairs[ends[k] : ends[k + 1]]
                change = np.bincount(mine[:, 0], minlength=len(data) + 1) - np.bincount(mine[:, 1] + length, minlength=len(data) + 1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) > 0))
                for c, v in zip(out, (doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(v)
            yield _arrays(out, names, types)

    return run


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_GRAM, held: int = HELD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; ``hot`` and ``held`` change the work only."""
    base, runs = removed_runs(docs, length, gram, hot, held)
    maybe, whole = split_by_keys(base, runs.select("row"), "row", runs.count())
    joined = maybe.join(runs, "row", "left")
    cut = joined.filter("pieces IS NOT NULL").select("doc_id", "text", "pieces").mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    whole = whole.unionByName(joined.filter("pieces IS NULL").select(whole.columns))
    none = F.lit(0).cast("long")
    untouched = whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return cut.unionByName(untouched)
