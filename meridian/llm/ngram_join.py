"""N-gram Jaccard self-join by multiple-global-order filtering.

A document is its set of distinct 5-word shingles. If two sets of sizes a and b reach the similarity, then
under *any* total order of the tokens their prefixes of n - ceil(t n) + 1 tokens share a token. Three
orders are used and a pair must pass all of them before it is verified on the whole sets:

1. rarest first, by frequency in a sample of the documents, then by hash. The equi-join on prefix tokens
   makes the pairs; common passages sort last and so rarely meet.
2. by hash. The prefixes under this order must meet, and their symmetric difference below the
   smaller threshold may not exceed what the similarity allows for the whole sets.
3. by the complement of the hash: the same.

An order only has to be the same for all documents, so the sample changes the work, never the result.

Equal sets are one class; one row per class is joined and members follow their class. Token groups of at most
LARGE rows give all their pairs, larger ones first only those with their first row. A larger group that these links leave in
several components is then joined as tiles (``tiles``): blocks of at most BLOCK rows and about
BLOCK_TOKENS tokens meet in one task each, which intersects the filters of all orders on the prefixes; the rows that are left
meet there again with their whole sets, are verified, and the links that span those found come back, so neither candidates nor links of a dense group leave it in pairs.
Blocks of far sizes never meet, nor do two blocks of the group's main component. With ``count_links`` the components
found so are gone through as such tiles once more, to count each row's links: every link lies in one component.

Defined cases: words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; null or wordless text has the empty
set, links with nothing, and its component is its own doc_id; rows with a null doc_id link like any
other but a component made only of them is null; rows that repeat a doc_id are one node of the graph with
several sets; a text of any length is read whole, its set held by one task at a time; an empty table gives an empty
result. Tokens and classes are 64-bit hashes; a collision of two
classes would merge them, one expected in 2^64 pairs of classes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, join_groups, materialize, released, split_by_keys, without_keys

WORDS, PERCENT = 5, 80
#: One document in SAMPLE is counted for the token order; a token is listed from LISTED sampled documents on.
SAMPLE, LISTED, MOST_LISTED = 10, 3, 400_000
#: Token groups above this size go through their first row before their other pairs are looked at.
LARGE = 16
#: Rows and tokens of a block, two of which one task pairs at once.
BLOCK, BLOCK_TOKENS = 1024, 1_000_000
#: Rows of a batch that holds prefixes or whole sets.
LONG_ROWS = 1000
#: A tile whose candidate pairs are at most this many times its rows gives them as pairs, a denser one its rows.
SPARSE = 4
#: A token that the sample expects in more rows than this is dealt in parts of about so many.
PART = 20_000
#: Labels of classes without a doc_id start here.
_NAMELESS = 1 << 62

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(max(1, n), np.uint64)
    out[1:] = base
    return np.cumprod(out)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word of a text, by one polynomial over the bytes."""
    data = np.frombuffer(text, np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    inverse = pow(int(_BASE), -1, 1 << 64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(len(data), int(_BASE)), out=total[1:])
    value = (total[end] - total[start]) * _powers(len(data) + 1, inverse)[start]
    return _mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words make one shingle, none the empty set."""
    h = word_hashes(text)
    n = len(h) - words + 1
    if n < 1:
        if not len(h):
            return h
        value = np.array([len(h)], np.uint64)
        for x in h:
            value = _mix(value * np.uint64(0x9FB21C651E98DF25) + x)
        return value
    out = np.full(n, words, np.uint64)
    for k in range(words):
        out = _mix(out * np.uint64(0x9FB21C651E98DF25) + h[k : k + n])
    return np.unique(out)


def set_hash(tokens: np.ndarray) -> int:
    total = _mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(_mix(np.array([total]))[0].view(np.int64))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _sets(batch, words: int):
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        yield doc_id, shingle_set((text.as_py() or "").encode(), words)


def _schema_batch(rows, types, names):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)


def token_order(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens common in a sample of the documents and their counts there, at most about MOST_LISTED."""

    def counted(sets):
        token, n = np.unique(np.concatenate(sets or [np.zeros(0, np.uint64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    def run(batches):
        for batch in batches:
            sets, size = [], 0
            for _, s in _sets(batch, words):
                sets.append(s)
                size += len(s)
                if size > 1_000_000:
                    yield counted(sets)
                    sets, size = [], 0
            yield counted(sets)

    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("doc_id", "text").dropDuplicates(["text"])
    counts = sample.mapInArrow(released(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= LISTED)
    counts = materialize(counts, "token-counts")
    least = LISTED
    size = counts.count()
    if size > MOST_LISTED:  # raise the bar until the list fits
        least = counts.approxQuantile("n", [1 - MOST_LISTED / size], 0.001)[0] + 1
    got = counts.filter(F.col("n") >= least).toPandas()
    token, n = got["token"].to_numpy().view(np.uint64), got["n"].to_numpy()
    by = np.argsort(token)
    return token[by], n[by]


def prefixes(docs: DataFrame, listed: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """doc_id, n, cid (hash of the set) and, as bytes, the prefixes under the three orders."""
    shared = docs.sparkSession.sparkContext.broadcast(listed)
    types, names = [pa.int64()] * 3 + [pa.binary()] * 3, ["doc_id", "n", "cid", "first", "second", "third"]

    def run(batches):
        token, count = shared.value
        for batch in batches:
            rows, size = [], 0
            for doc_id, s in _sets(batch, words):
                p, rank = prefix_size(len(s), percent), np.zeros(len(s), np.int64)
                if len(token) and len(s):
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    rank = np.where(token[at] == s, count[at], 0)
                first = s[np.argsort(rank, kind="stable")[:p]].tobytes()
                rows.append((doc_id, len(s), set_hash(s), first, _short(s[:p]), _short(s[len(s) - p :])) if len(s) else (doc_id, 0, 0, b"", b"", b""))
                size += len(first)
                if size > 4_000_000:
                    yield _schema_batch(rows, types, names)
                    rows, size = [], 0
            yield _schema_batch(rows, types, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, n long, cid long, first binary, second binary, third binary")


def _short(tokens: np.ndarray) -> bytes:
    """The upper 32 bits; tokens that collide count as common, which only weakens the filter."""
    return (tokens >> np.uint64(32)).astype("<u4").tobytes()


def _need(a, b, percent):
    """Least intersection of sets of sizes a and b that reaches the similarity."""
    return -(-percent * (a + b) // (100 + percent))


class _Rows:
    """Columns of one or more token groups, rows of a group together."""

    names = ("cid", "n", "at", "prev")

    def __init__(self, part: pd.DataFrame):
        self.cid, self.n, self.at, self.prev = (part[c].to_numpy() for c in self.names)

    def fitting(self, a: np.ndarray, b: np.ndarray, percent: int, first_only: bool) -> np.ndarray:
        """Pairs of row numbers that pass the size and position bounds; with ``first_only`` not those whose tokens before are equal too."""
        low, high = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        reach = np.minimum(self.n[a] - self.at[a], self.n[b] - self.at[b])
        fine = (100 * low >= percent * high) & (reach >= _need(self.n[a], self.n[b], percent)) & (self.cid[a] != self.cid[b])
        if first_only:
            fine &= (self.at[a] == 0) | (self.at[b] == 0) | (self.prev[a] != self.prev[b])
        a, b = self.cid[a[fine]], self.cid[b[fine]]
        return np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    change = np.zeros(len(keys[0]) - 1, bool)
    for key in keys:
        change |= key[1:] != key[:-1]
    return np.flatnonzero(np.r_[True, change, True])


_NO_ROWS = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "b", "token", "n", "at", "prev", "place")})


def _first_pass(percent: int, common=None):
    """Pairs (a, b) of small groups and of large ones with their first row; rows of large groups come back with b = a.

    Groups of the broadcast tokens ``common`` are parts of larger ones, so they count as large whatever their size.
    """

    def out(pairs: list, rest: list) -> pd.DataFrame:
        found = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
        frame = pd.DataFrame({"a": found[:, 0], "b": found[:, 1]}).assign(token=0, n=0, at=0, prev=0, place=0)
        return pd.concat([frame, *rest], ignore_index=True)

    def groups(part: pd.DataFrame, pairs: list, rest: list, begun, before: int):
        """``begun``: a token of which ``before`` rows after the first went out before, so that it is large."""
        rows, new = _Rows(part), _runs(part["token"].to_numpy())
        sizes, token = np.diff(new), part["token"].to_numpy()[new[:-1]]
        big = sizes > LARGE
        if begun is not None:
            big |= token == begun
        if common is not None:
            big |= np.isin(token, common.value[0])
        for size in np.unique(sizes[(sizes > 1) & ~big]):
            start = new[:-1][(sizes == size) & ~big]
            i, j = np.triu_indices(size, 1)
            pairs.append(rows.fitting((start[:, None] + i).ravel(), (start[:, None] + j).ravel(), percent, True))
        large = np.flatnonzero(np.repeat(big, sizes))
        if len(large):
            head = np.repeat(new[:-1], sizes)[large]
            pairs.append(rows.fitting(head, large, percent, False))
            place = large - head + (before if begun is not None else 0) * (part["token"].to_numpy()[large] == begun)
            rest.append(part.iloc[large].assign(a=rows.cid[large], b=rows.cid[large], place=place)[list(_NO_ROWS)])

    def run(parts):
        held, begun, before, pairs, rest = None, None, 0, [], []
        for part in parts:
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            last = (part["token"] == part["token"].iat[-1]).to_numpy()
            held = part[last].reset_index(drop=True)
            if not last.all():
                groups(part[~last].reset_index(drop=True), pairs, rest, begun, before)
                begun = None
            if len(held) > 50_000:  # one token over many batches: only its first row stays here
                groups(held, pairs, rest, begun, before)
                before = (before if begun is not None else 0) + len(held) - 1
                begun, held = held["token"].iat[0], held.iloc[:1].reset_index(drop=True)
            if sum(map(len, pairs)) + sum(map(len, rest)) > 200_000:
                yield out(pairs, rest)
                pairs, rest = [], []
        if held is not None:
            groups(held, pairs, rest, begun, before)
        if pairs or rest:
            yield out(pairs, rest)

    return run


def first_pairs(classes: DataFrame, listed: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs of class ids from the first pass, and the rows (cid, token, n, at, prev, place) of large token groups."""
    common = listed[1] * SAMPLE > PART
    shared = classes.sparkSession.sparkContext.broadcast((listed[0][common].view(np.int64), -(-listed[1][common] * SAMPLE // PART)))

    def explode(batches):
        common, parts = shared.value
        by = np.argsort(common)
        common, parts = common[by], parts[by]
        for batch in batches:
            cid, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            tokens = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            token, cids = np.concatenate(tokens or [np.zeros(0, np.int64)]), np.repeat(cid, sizes)
            part = np.zeros(len(token), np.int32)
            if len(common):
                where = np.minimum(np.searchsorted(common, token), len(common) - 1)
                part = np.where(common[where] == token, cids % parts[where], 0).astype(np.int32)
            columns = [token, cids, np.repeat(n, sizes).astype(np.int32), at.astype(np.int32), np.r_[0, token[:-1]] if len(token) else token, part]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "cid", "n", "at", "prev", "part"])

    postings = classes.select("cid", "n", "first").mapInArrow(released(explode), "token long, cid long, n int, at int, prev long, part int")
    dealt = postings.repartition("token", "part").sortWithinPartitions("token", "part", "cid")
    found = materialize(dealt.mapInPandas(released(_first_pass(percent, shared if common.any() else None)), "a long, b long, token long, n int, at int, prev long, place long"), "first-pass")
    rest = found.filter("a = b").select(F.col("a").alias("cid"), "token", "n", "at", "prev", "place")
    pairs = found.filter("a <> b").select("a", "b")
    if common.any():  # the parts of a common token meet through their first rows
        heads = rest.filter("place = 0").select("token", "cid")
        least = heads.groupBy("token").agg(F.min("cid").alias("least"))
        met = heads.join(least, "token").filter("cid <> least")
        pairs = pairs.unionByName(met.select(F.least("cid", "least").alias("a"), F.greatest("cid", "least").alias("b")))
    return pairs.distinct(), rest


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``: products for the tokens that many rows share, an index for the others."""
    if len(a) * len(b) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a]).reshape(len(a), len(b))
    tokens, number = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (a, b))
    of_a, of_b = number[: len(row_a)], number[len(row_a) :]
    n_a, n_b = np.bincount(of_a, minlength=len(tokens)), np.bincount(of_b, minlength=len(tokens))
    dense = (n_a * n_b * 100 > len(a) * len(b)) & (n_a > 0) & (n_b > 0)
    out = np.zeros((len(a), len(b)), np.float32)
    column = np.cumsum(dense) - 1
    for at in range(0, int(dense.sum()), 2048):
        sides = []
        for rows, of, height in ((row_a, of_a, len(a)), (row_b, of_b, len(b))):
            mine = dense[of] & (column[of] >= at) & (column[of] < at + 2048)
            side = np.zeros((height, min(2048, int(dense.sum()) - at)), np.float32)
            side[rows[mine], column[of[mine]] - at] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    by = np.argsort(of_a, kind="stable")
    start = np.cumsum(n_a) - n_a
    mine = np.flatnonzero(~dense[of_b] & (n_a[of_b] > 0))
    step = max(1, int(4_000_000 // max(1, n_a[of_b[mine]].max(initial=1))))
    for at in range(0, len(mine), step):
        entry = mine[at : at + step]
        times = n_a[of_b[entry]]
        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        met = row_a[by[np.repeat(start[of_b[entry]], times) + offset]] * len(b) + np.repeat(row_b[entry], times)
        out += np.bincount(met, minlength=out.size).reshape(out.shape)
    return out.astype(np.int64)


def _ends(whole: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of a sorted set under the second and third order, the latter as complements, so that both ascend."""
    p = prefix_size(len(whole), percent)
    return whole[:p], ~whole[len(whole) - p :][::-1]


def passing(a: list[tuple], b: list[tuple], n_a: np.ndarray, n_b: np.ndarray, allowed: np.ndarray, percent: int) -> np.ndarray:
    """Which of the ``allowed`` pairs of rows pass both orders: their prefixes meet and differ by no more than the whole sets may."""
    n_a, n_b = n_a[:, None].astype(np.int64), n_b[None, :].astype(np.int64)
    most = n_a + n_b - 2 * _need(n_a, n_b, percent)
    fine = allowed & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
    for order in range(len(a[0])):
        i, j = np.flatnonzero(fine.any(axis=1)), np.flatnonzero(fine.any(axis=0))
        if not len(i):
            break
        x, y = [a[k][order] for k in i], [b[k][order] for k in j]
        both = overlaps(x, y)
        last_x, last_y = np.array([v[-1] for v in x]), np.array([v[-1] for v in y])
        # tokens below the smaller last one, where both lists are whole
        below = np.stack([np.searchsorted(v, np.minimum(v[-1], last_y)) for v in x]) + np.stack([np.searchsorted(v, np.minimum(v[-1], last_x)) for v in y]).T
        at = np.ix_(i, j)
        fine[at] &= (both > 0) & (below - 2 * both <= most[at])
    return fine


def similar(a: list[np.ndarray], b: list[np.ndarray], allowed: np.ndarray, percent: int) -> np.ndarray:
    """Which of the ``allowed`` pairs of sorted sets are similar: the filters first, then the whole sets of the rows that are left."""
    n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    fine = passing([_ends(x, percent) for x in a], [_ends(x, percent) for x in b], n_a, n_b, allowed, percent)
    i, j = np.flatnonzero(fine.any(axis=1)), np.flatnonzero(fine.any(axis=0))
    if len(i):
        both, at = overlaps([a[k] for k in i], [b[k] for k in j]), np.ix_(i, j)
        fine[at] &= 100 * both >= percent * (n_a[i][:, None] + n_b[j] - both)
    return fine


def spanning(links: np.ndarray, apart: bool) -> np.ndarray:
    """Rows (i, j) of links that connect all that the links do; with ``apart`` columns are other nodes than rows."""
    n = links.shape[0]
    if apart:
        links = np.block([[np.zeros((n, n), bool), links], [links.T, np.zeros((links.shape[1],) * 2, bool)]])
    free, out = links.any(axis=1), []
    for first in np.flatnonzero(free):
        if not free[first]:
            continue
        free[first], edge = False, [first]
        while edge:
            at = edge.pop()
            new = np.flatnonzero(links[at] & free)
            free[new] = False
            out += [(at, k) for k in new]
            edge += new.tolist()
    return np.array(out, np.int64).reshape(-1, 2)


def _tiles(batches):
    """Runs of rows of one tile, from sorted batches, with the row numbers of its two blocks (the same, for a block with itself)."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
        if held is None or not len(held):
            continue
        new = _runs(held.column("grp").to_numpy(), held.column("tile").to_numpy())
        for a, b in zip(new[:-1], new[1:], strict=True) if batch is None else zip(new[:-2], new[1:-1], strict=True):
            tile = held.slice(a, b - a).combine_chunks()
            side = tile.column("side").to_numpy()
            rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not tile.column("double")[0].as_py():
                yield tile, rows, rows
            elif len(rows) and len(columns):
                yield tile, rows, columns
        held = held.slice(new[-2])


def _apart(tile, rows, columns, name) -> np.ndarray:
    value = tile.column(name).to_numpy()
    return value[rows][:, None] != value[columns]


def _candidate_task(percent: int):
    names = ["grp", "tile", "side", "double", "cid", "label", "size"]

    def pair_batch(found):
        pairs = np.unique(np.concatenate(found or [np.zeros((0, 2), np.int64)]), axis=0)
        columns = [pa.array(pairs[:, k]) if c in ("a", "b") else pa.nulls(len(pairs), t) for k, c, t in zip((0, 1, *[0] * 7), ("a", "b", *names), [pa.int64()] * 2 + kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", *names])

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        found = []
        for tile, rows, columns in _tiles(batches):
            at, prev, cid = (tile.column(c).to_numpy() for c in ("at", "prev", "cid"))
            # rows whose tokens before are equal too meet under that token
            met = (at[rows] > 0)[:, None] & (at[columns] > 0) & (prev[rows][:, None] == prev[columns])
            allowed = _apart(tile, rows, columns, "label") & ~met
            if not allowed.any():
                continue
            # common tokens before these ones are few, so both must have enough tokens from here on
            n = tile.column("n").to_numpy()
            left = np.minimum((n - at)[rows][:, None], (n - at)[columns])
            allowed &= left >= _need(n[rows][:, None], n[columns], percent)
            if not allowed.any():
                continue
            some = [np.flatnonzero(allowed.any(axis=k)) for k in (1, 0)]
            rows, columns, twice = *(side[k] for side, k in zip((rows, columns), some, strict=True)), columns is not rows
            allowed = allowed[np.ix_(*some)]
            ends = {}
            for k in np.union1d(rows, columns):
                ends[k] = (np.unique(np.frombuffer(tile.column("second")[k].as_buffer(), "<u4")),)
            fine = passing([ends[k] for k in rows], [ends[k] for k in columns], n[rows], n[columns], allowed, percent)
            i, j = np.nonzero(fine)
            if not twice:
                i, j = i[rows[i] < columns[j]], j[rows[i] < columns[j]]
            if len(i) <= SPARSE * (len(rows) + len(columns)):
                a, b = cid[rows[i]], cid[columns[j]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
                if sum(map(len, found)) > 200_000:
                    yield pair_batch(found)
                    found = []
            else:
                hit = tile.select(names).take(pa.array(np.union1d(rows[i], columns[j])))
                yield from pa.table([pa.nulls(len(hit), pa.int64())] * 2 + hit.columns, names=["a", "b", *names]).to_batches()
        yield pair_batch(found)

    return run


def _link_task(percent: int, count: bool):
    def batch(found):
        columns = [np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b"])

    def run(batches):
        out = []
        for tile, rows, columns in _tiles(batches):
            whole = [np.frombuffer(x.as_buffer(), np.uint64) for x in tile.column("whole")]
            links = similar([whole[k] for k in rows], [whole[k] for k in columns], _apart(tile, rows, columns, "cid" if count else "label"), percent)
            cid, size, twice = tile.column("cid").to_numpy(), tile.column("size").to_numpy(), columns is not rows
            if count:
                out += [(cid[rows], links @ size[columns])] + ([(cid[columns], links.T @ size[rows])] if twice else [])
            else:
                i, j = spanning(links, twice).T
                nodes = np.r_[cid[rows], cid[columns]] if twice else cid[rows]
                out.append((nodes[i], nodes[j]))
            if sum(len(x[0]) for x in out) > 200_000:
                yield batch(out)
                out = []
        yield batch(out)

    return run


def tiles(rows: DataFrame, percent: int) -> DataFrame:
    """grp, tile, side, double, cid, label, size: each row once for each pair of blocks of its group that it is in.

    ``rows``: grp, cid, label, n, size (of the class), main (boolean; two such rows need not meet), and others that are kept.
    """
    fits = F.col("tokens") <= BLOCK_TOKENS
    per_group = rows.groupBy("grp").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens")).select("grp", (fits & (F.col("rows") <= BLOCK)).alias("whole_grp"))
    near = F.floor(F.log(F.col("n")) / float(np.log(100 / percent))).cast("long")
    rows = rows.join(per_group, "grp").withColumn("kind", F.when(F.col("whole_grp"), F.lit(0)).otherwise(2 * near + F.col("main").cast("long")))
    kinds = rows.groupBy("grp", "kind").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    kinds = kinds.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("kind", "blocks"))).alias("kinds"))
    rows = rows.join(kinds, "grp")

    def code(kind, block):
        return kind * (1 << 20) + block

    def meets(k):
        close = F.abs(F.shiftright(k, 1) - F.shiftright(F.col("kind"), 1)) <= 1
        return close & ((k.bitwiseAND(F.lit(1)) == 0) | (F.col("kind").bitwiseAND(F.lit(1)) == 0))

    mine = code(F.col("kind"), F.pmod(F.xxhash64("cid", F.lit(3)), F.element_at("kinds", F.col("kind"))))
    others = F.flatten(F.transform(F.filter(F.map_keys("kinds"), meets), lambda k: F.transform(F.sequence(F.lit(0), F.element_at("kinds", k) - 1), lambda b: code(k, b))))
    more = [c for c in rows.columns if c in ("at", "prev")]
    rows = rows.select("grp", "cid", "label", "size", *more, mine.alias("mine"), F.explode(others).alias("other"))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return rows.select("grp", (low * (1 << 28) + high).alias("tile"), (F.col("mine") > low).cast("int").alias("side"), (low < high).alias("double"), "cid", "label", "size", *more)


def _dealt(placed: DataFrame) -> DataFrame:
    return placed.repartition("grp", "tile").sortWithinPartitions("grp", "tile", "side", "cid")


def candidates(placed: DataFrame, lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What passes the second order too, with a row of another label: pairs, and the rows of tiles that have too many for that."""
    wanted = placed.select("cid").distinct()
    mine, _ = split_by_keys(lists.select("cid", "n", "second"), wanted, "cid", wanted.count())
    dealt = _dealt(placed.join(mine, "cid").select(*placed.columns, "n", "second"))
    schema = "a long, b long, grp long, tile long, side int, double boolean, cid long, label long, size long"
    with arrow_rows(placed.sparkSession, LONG_ROWS):
        found = materialize(dealt.mapInArrow(released(_candidate_task(percent)), schema), "tile-candidates")
    return found.filter("a IS NOT NULL").select("a", "b").distinct(), found.filter("a IS NULL").drop("a", "b")


def tile_links(placed: DataFrame, sets: DataFrame, percent: int, count: bool) -> DataFrame:
    """Links (a, b) that connect the labels of each tile's similar rows, or with ``count`` (a, number of rows that it is linked with)."""
    with arrow_rows(placed.sparkSession, LONG_ROWS):
        return materialize(_dealt(placed.join(sets, "cid").select(*placed.columns, "whole")).mapInArrow(released(_link_task(percent, count)), "a long, b long"), "tile-links")


def _filter_orders(percent: int):
    def near(x, y, most, last):
        """Tokens on this side of the smaller threshold, where both lists are whole: they must meet and differ little."""
        if not np.intersect1d(x, y).size:
            return False
        inside = (lambda v, t: v > t) if last else (lambda v, t: v < t)
        edge = max(x.min(), y.min()) if last else min(x.max(), y.max())
        x, y = np.unique(x[inside(x, edge)]), np.unique(y[inside(y, edge)])
        return len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)) <= most

    def run(batches):
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            fine = np.ones(len(a), bool)
            for last, columns in ((False, (4, 5)), (True, (6, 7))):
                lists = [[np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(i)] for i in columns]
                for i in np.flatnonzero(fine):
                    fine[i] = near(lists[0][i], lists[1][i], n_a[i] + n_b[i] - 2 * _need(n_a[i], n_b[i], percent), last)
            yield pa.RecordBatch.from_arrays([pa.array(a[fine]), pa.array(b[fine])], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fine = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                fine[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[fine]), pa.array(b[fine])], names=["a", "b"])

    return run


def filter_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the second and third order."""
    pairs = materialize(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    classes, _ = split_by_keys(classes.select("cid", "n", "second", "third"), ends, "cid", ends.count())
    x = classes.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("second").alias("x2"), F.col("third").alias("x3"))
    y = classes.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("second").alias("y2"), F.col("third").alias("y3"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "x2", "y2", "x3", "y3")
    with arrow_rows(pairs.sparkSession, LONG_ROWS):
        return materialize(both.mapInArrow(released(_filter_orders(percent)), "a long, b long"), "filtered-pairs")


def whole_sets(docs: DataFrame, cids: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """cid, whole (tokens as bytes) of the given classes. ``reps``: cid and one doc_id that has it."""
    ends = materialize(cids.join(reps, "cid"), "set-ends")
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NAMELESS)).alias("key"))
    keys = ends.select(F.coalesce("rep", F.lit(_NAMELESS)).alias("key"))
    maybe, _ = split_by_keys(keyed, keys, "key", ends.count())

    def whole(batches):
        for batch in batches:
            rows, size = [], 0
            for _, s in _sets(batch, words):
                rows.append((set_hash(s), s.tobytes()))
                size += s.nbytes
                if size > 8_000_000:  # a batch of whole sets would be large
                    yield _schema_batch(rows, [pa.int64(), pa.binary()], ["cid", "whole"])
                    rows, size = [], 0
            yield _schema_batch(rows, [pa.int64(), pa.binary()], ["cid", "whole"])

    found = maybe.select("doc_id", "text").mapInArrow(released(whole), "cid long, whole binary").join(ends.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])
    with arrow_rows(docs.sparkSession, LONG_ROWS):
        return materialize(found, "whole-sets")


def verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x, y = (sets.select(F.col("cid").alias(end), F.col("whole").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    with arrow_rows(pairs.sparkSession, LONG_ROWS):
        return materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(released(_verify(percent)), "a long, b long"), "links")


def open_groups(rest: DataFrame, known: DataFrame) -> DataFrame:
    """Rows for ``tiles`` of the large token groups that lie in several components.

    A group whose rows all have the same token before this one is left out: its pairs meet under that token.
    """
    rest = rest.join(known, "cid")
    per_token = rest.groupBy("token").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("label", "place").alias("first_label"), F.min("prev").alias("p"), F.max("prev").alias("q"), F.min("at").alias("least_at")
    )
    live = per_token.filter("lo <> hi AND NOT (p = q AND least_at > 0)")
    rows = rest.join(live.select("token", "first_label"), "token")
    main = F.col("label") == F.col("first_label")
    return rows.select(F.col("token").alias("grp"), "cid", "label", F.col("n").cast("long").alias("n"), F.lit(1).cast("long").alias("size"), main.alias("main"), "at", "prev")


def similar_classes(docs: DataFrame, words: int, percent: int, count_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n, cid) and classes (cid, size, label, root; with ``count_links`` others, the rows of linked classes)."""
    listed = token_order(docs, words)
    with arrow_rows(docs.sparkSession, LONG_ROWS):
        rows = materialize(prefixes(docs, listed, words, percent).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    members = rows.select("doc_id", "n", "cid")
    classes = rows.filter("n > 0").groupBy("cid").agg(F.count("*").alias("size"), F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("row").alias("pick"))
    nameless = F.lit(_NAMELESS) + F.col("cid").bitwiseAND(F.lit(_NAMELESS // 2 - 1))
    classes = materialize(classes.withColumn("label", F.coalesce("rep", nameless)), "classes")
    again = rows.filter("n > 0").select("row", "cid").join(classes.filter("size > 1").select("cid", "pick"), "cid").filter("row <> pick").select("row")
    again = materialize(again, "repeated-sets")
    lists = without_keys(rows.filter("n > 0"), again, "row", again.count())
    reps, labels = classes.select("cid", "rep"), classes.select("cid", "label")
    pairs, rest = first_pairs(lists, listed, percent)
    pairs = filter_pairs(pairs, lists, percent)
    sets = whole_sets(docs, pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), reps, words)
    links = verify_pairs(pairs, sets, percent)

    def rooted(links):
        roots = components(links, labels)
        return materialize(labels.join(roots.withColumnRenamed("u", "label"), "label", "left").select("cid", F.coalesce("v", "label").alias("label")), "known")

    known = rooted(links)
    opened = materialize(open_groups(rest, known), "open-groups")
    placed = materialize(tiles(opened, percent), "tiles")
    discard(opened)
    pairs, dense = candidates(placed, lists, percent)
    pairs = filter_pairs(pairs, lists, percent)
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(dense.select("cid")).distinct()
    missing = materialize(wanted.join(sets.select("cid"), "cid", "left_anti"), "missing-sets")
    if not missing.isEmpty():
        sets = sets.unionByName(whole_sets(docs, missing, reps, words))
    more = verify_pairs(pairs, sets, percent)
    if not dense.isEmpty():
        more = more.unionByName(tile_links(dense, sets, percent, False).distinct())
    if not more.isEmpty():
        links = links.unionByName(more)
        known = rooted(links)
    classes = classes.join(known.select("cid", F.col("label").alias("root")), "cid")
    if count_links:
        several = classes.groupBy("root").count().filter("count > 1").select("root")
        grouped = classes.join(several, "root").select(F.col("root").alias("grp"), "cid", "label", "n", "size", F.lit(False).alias("main"))
        others = tile_links(tiles(materialize(grouped, "grouped"), percent), sets, percent, True).groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("others"))
        classes = classes.join(others, "cid", "left")
    return members, classes


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """cid, root of every class that has a link: the smallest label reachable, by rounds of large and small stars.

    ``labels`` gives each cid's label. Rounds end when no edge changes; each is written, so lost executors cost little.
    """
    a, b = labels.select(F.col("cid").alias("a"), F.col("label").alias("u")), labels.select(F.col("cid").alias("b"), F.col("label").alias("v"))
    edges = materialize(links.join(a, "a").join(b, "b").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        # large star: every larger neighbour of u is tied to u's smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, class_size (documents with the same set) of every document; with ``count_links`` also n_links."""
    members, classes = similar_classes(docs, words, percent, count_links)
    component = F.col("root")
    n_links = [(F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")] if count_links else []
    classes = materialize(classes.select("cid", F.col("size").alias("class_size"), F.when(component < _NAMELESS, component).alias("component"), *n_links), "classes-out")
    spread = F.xxhash64("doc_id", F.lit("spread"))
    alone = F.col("n") == 0
    rows = members.withColumn("cid", F.when(alone, spread).otherwise(F.col("cid")))
    out = join_groups(rows, classes, "cid", "class_size", members.count(), spread)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    n_links = [F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links")] if count_links else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"), *n_links)


def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without those that are not the smallest doc_id of their group; null doc_ids stay."""
    found = near_duplicates(docs, words, percent)
    dropped = materialize(found.filter("doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias("gone id")), "near-copies")
    return without_keys(docs.withColumn("gone id", docs["doc_id"]), dropped, "gone id", dropped.count()).drop("gone id")
