"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's four 16-bit segments are read as words of the perfect binary Golay code (23 bits, distance 7),
padded with zeros. A word has one codeword within three bits and, if it is three away from it, five more at four bits.
Two words at most two bits apart share a codeword among those; at one bit, the nearest codeword of the one is among those of the other.

At most four differing bits over four segments leave three cases, one key set each (``fuzzy_keys``):
two segments agree (six pairs of segments); exactly one agrees, so that the others differ by one or two bits and
the next one shares a codeword (four keys with a codeword); or all differ by one bit, so that the first two share a codeword
of the one with a nearest codeword of the other, and the parity of every segment changes.
Fingerprints that share a key meet, hot keys in blocks, and are verified by counting differing bits inside the task,
which returns links of small groups and only a spanning star of each linked set of large ones.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any other; fewer than four words are one
shingle; long texts are hashed in windows; repeated rows and ties share a fingerprint; a null doc_id never is the smallest,
and a component without doc_ids has a null one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, released

WORDS = 4
BITS = 4
#: Bytes of a text that are split into words at a time.
WINDOW = 1 << 20
#: Rows of a key that meet in one tile side; a key with more is dealt into blocks, and every pair of blocks is a tile.
BLOCK = 1024
#: Runs up to this length return their links, longer ones a star of each linked set.
SMALL = 16
#: Generator of the cyclic Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011

_SPACE = re.compile(rb"[ \t-\r]")
_PAIRS = list(combinations(range(4), 2))


def _windows(data: bytes, words: int):
    """Word lists of the text's windows; each begins with the last words of the one before, so every shingle is in exactly one."""
    at, carry = 0, []
    while at < len(data):
        cut = _SPACE.search(data, at + WINDOW)
        end = cut.start() if cut else len(data)
        found = carry + data[at:end].split()
        if len(found) >= words or end == len(data):
            yield found
            found = found[len(found) - words + 1 :] if len(found) >= words else []
        carry, at = found, end


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bits that more than half of the shingles' XXH64 have."""
    counts, n = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    for found in _windows((text or "").encode("utf-8", "surrogatepass").lower(), words):
        if not found or (n and len(found) < words):
            continue
        joined = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = max(1, len(found) - words + 1)
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[-last:].tolist(), strict=True)), np.uint64, last)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += last
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every document."""

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, fp long")


def codewords() -> np.ndarray:
    """The 4 096 codewords; a codeword's place is the index that keys carry."""
    index = np.arange(4096, dtype=np.uint32)
    rest = index << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> np.uint32(bit) & 1, rest ^ np.uint32(GENERATOR << (bit - 11)), rest)
    return index << 11 | rest


def decoding(bits: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word of ``bits`` bits: place of its list, the lists of codeword indices within four bits, and its nearest codeword.

    Built from the codewords outwards: each reaches the words that differ from it by a pattern of at most four bits.
    """
    code, top = codewords(), 23 - bits
    beyond = np.bitwise_count(code >> np.uint32(bits)).astype(int)
    patterns = {0: np.zeros(1, np.uint32)} | {n: np.array([sum(1 << p for p in c) for c in combinations(range(bits), n)], np.uint32) for n in range(1, 5)}
    words, near, far = [], [], []
    for outside in range(min(top, 4) + 1):
        index = np.flatnonzero(beyond == outside)
        low = code[index] & np.uint32((1 << bits) - 1)
        for n in range(5 - outside):
            words.append((low[:, None] ^ patterns[n]).ravel())
            near.append(np.repeat(index, len(patterns[n])))
            far.append(np.full(len(words[-1]), outside + n))
    words, near, far = map(np.concatenate, (words, near, far))
    order = np.lexsort((near, words))
    words, near, far = words[order], near[order], far[order]
    starts = np.searchsorted(words, np.arange((1 << bits) + 1))
    nearest = np.zeros(1 << bits, np.int64)
    nearest[words[far <= 3]] = near[far <= 3]
    return starts, near.astype(np.int64), nearest


def fuzzy_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the place of the fingerprint each belongs to; a key's bits from 32 on say which rule made it."""
    starts, near, nearest = tables
    seg = [(fps >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    size = starts[1:] - starts[:-1]
    every = np.arange(len(fps))

    def listed(who: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``who`` once for each codeword of segment i, and those codewords."""
        word = seg[i][who]
        n = size[word]
        at = np.repeat(np.arange(len(who)), n)
        return at, near[starts[word][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]

    keys, owners = [], []
    for tag, (i, j) in enumerate(_PAIRS):
        keys.append(tag << 32 | seg[i] << 16 | seg[j])
        owners.append(every)
    for i in range(4):
        at, c = listed(every, (i + 1) % 4)
        keys.append((6 + i) << 32 | seg[i][at] << 12 | c)
        owners.append(at)
    parity = sum((np.bitwise_count(seg[i]).astype(np.int64) & 1) << i for i in range(4))
    keys.append(10 << 32 | nearest[seg[0]] << 16 | nearest[seg[1]] << 4 | parity)
    owners.append(every)
    one, c0 = listed(every, 0)
    two, c1 = listed(one, 1)
    keys.append(10 << 32 | c0[two] << 16 | c1 << 4 | parity[one[two]] ^ 15)
    owners.append(one[two])
    return np.concatenate(keys), np.concatenate(owners)


def keyed(fps: DataFrame) -> DataFrame:
    """key, fp: every fuzzy key of the fingerprints in column fp."""

    def run(batches):
        tables = decoding()
        for batch in batches:
            values = batch.column(0).to_numpy()
            for part in range(0, len(values), 4096):
                some = values[part : part + 4096]
                keys, owners = fuzzy_keys(some.view(np.uint64), tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[owners])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _first_of_kind(key: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the pair with differing bits x belongs to this key's rule, so that it is returned by few of the keys that it shares."""
    same = np.stack([(x >> np.uint64(16 * i) & np.uint64(0xFFFF)) == 0 for i in range(4)])
    n, tag = same.sum(axis=0), key >> 32
    first = np.argmax(same, axis=0)
    second = np.argmax(same & (np.arange(4)[:, None] != first), axis=0)
    pair = np.zeros((4, 4), int)
    for t, (i, j) in enumerate(_PAIRS):
        pair[i, j] = t
    return np.where(n >= 2, tag == pair[first, second], np.where(n == 1, tag == 6 + first, tag == 10))


def _small_links(key, run, fp, bits):
    """Links inside runs, by comparing rows at growing distance."""
    for lag in range(1, SMALL):
        here = np.flatnonzero(run[:-lag] == run[lag:]) if lag < len(run) else np.zeros(0, int)
        if not len(here):
            return
        x = fp[here] ^ fp[here + lag]
        fine = (x != 0) & (np.bitwise_count(x) <= bits)
        here, x = here[fine], x[fine]
        here = here[_first_of_kind(key[here], x)]
        yield fp[here], fp[here + lag]


def _stars(fp: np.ndarray, bits: int):
    """A star over each set of fingerprints that is linked inside one run."""
    fp = np.unique(fp)
    adjacent = np.empty((len(fp), len(fp)), bool)
    for i in range(0, len(fp), 256):
        adjacent[i : i + 256] = np.bitwise_count(fp[i : i + 256, None] ^ fp) <= bits
    unseen = np.ones(len(fp), bool)
    while unseen.any():
        seed = int(np.argmax(unseen))
        frontier, member = np.array([seed]), np.zeros(len(fp), bool)
        member[seed] = True
        while len(frontier):
            grown = adjacent[frontier].any(axis=0) & ~member
            member |= grown
            frontier = np.flatnonzero(grown)
        unseen &= ~member
        member[seed] = False
        yield np.full(member.sum(), fp[seed]), fp[member]


def _tile_links(bits: int):
    """Task over rows (key, t1, t2, fp) in order: the links of every run of equal (key, t1, t2)."""

    def finish(key, t1, t2, fp):
        if not len(key):
            return
        new = np.r_[True, (key[1:] != key[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])]
        run, begins = np.cumsum(new), np.flatnonzero(new)
        length = np.diff(np.r_[begins, len(key)])
        small = (length <= SMALL)[run - 1]
        found = list(_small_links(key[small], run[small], fp[small], bits))
        for k in np.flatnonzero(length > SMALL):
            found += _stars(fp[begins[k] : begins[k] + length[k]], bits)
        if found:
            a, b = (np.concatenate(side).view(np.int64) for side in zip(*found, strict=True))
            edges = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(4)]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            whole = len(last) if not last.any() else int(np.argmax(last))
            yield from finish(*(x[:whole] if i < 3 else x[:whole].view(np.uint64) for i, x in enumerate(held)))
            held = [x[whole:] for x in held]
        yield from finish(*held[:3], held[3].view(np.uint64))

    return run


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """u, v (u > v): edges that connect exactly what links of at most ``bits`` (up to 4) differing bits connect. ``fps`` has distinct fp."""
    if bits > 4:
        raise ValueError("the keys find pairs of at most four differing bits")
    rows = keyed(fps)
    groups = materialize(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "shared-keys")
    total = groups.agg(F.sum("size")).first()[0] or 0
    met = join_groups(rows, groups, "key", "size", total, F.xxhash64("fp")).filter("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("long")
    met = met.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(11)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiled = met.select("key", "fp", "mine", other).select("key", F.least("mine", "other").alias("t1"), F.greatest("mine", "other").alias("t2"), "fp")
    dealt = tiled.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "fp")
    return dealt.mapInArrow(released(_tile_links(bits)), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, root (smallest id reachable) of every end of the edges (u > v): rounds of large and small stars, safe for hubs."""
    edges = materialize(edges.select("u", "v").filter("u > v").distinct(), "edges")
    before, now = None, (edges.count(), None)
    spread = F.xxhash64("v", F.lit("hub"))
    while now[0] and now != before:
        # large star: every larger neighbour of u is tied to u's smallest neighbour or u itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("size"))
        large = join_groups(both.filter("v > u"), least, "u", "size", 2 * now[0], spread)
        large = materialize(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # small star: u and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        small = join_groups(large, least, "u", "size", 2 * now[0], spread).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct(), "edges")
        before, now = now, tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def near_fingerprints(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fp (signed long), component_id, class_size (documents with the fingerprint), one row per document."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.count("*").alias("class_size"), F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(links(classes, bits))
    rooted = classes.join(roots, classes["fp"] == roots["id"], "left").select("fp", "class_size", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    whole = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "components")
    found = join_groups(rooted, whole.filter("n > 1"), "root", "n", rooted.count(), F.xxhash64("fp"))
    found = materialize(found.select("fp", "class_size", F.coalesce("component_id", "least").alias("component_id")), "classes-out")
    spread = F.xxhash64("doc_id", F.lit("spread"))
    return join_groups(rows, found, "fp", "class_size", rows.count(), spread).select("doc_id", "fp", "component_id", "class_size")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id, class_size of every document."""
    found = near_fingerprints(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")
