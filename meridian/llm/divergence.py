"""Divergence between the sources of a language, by hash-consed segment trees of their term counts.

Each language keeps the terms that enough of its documents hold. Its terms are dealt by hash into shards of about WIDTH;
in a shard they have ids, commonest first, so that what rare terms' counts share lies together. A source's counts in a
shard are a segment tree whose nodes are hash-consed: equal count subtrees of any sources and places are one node.
Two trees are gone through together from their roots; equal pairs of nodes become one with a number of places,
so that every pair of leaves (two counts) is priced once for two sources and not once for every term.
Partial sums over shards are added by Spark. Against the language's own tree the same traversal keeps the best price
below each pair of nodes and goes down only where the leading terms are.

A count c of a group with N counts has p = 1 + floor(10^9 (c + 2) / (N + 2 V)); a term's price is floor((p - q)^2 / (p + q)).
All of it is whole numbers. A shard of many sources is dealt into tiles of source blocks, so no task holds more than
2 SIDE sources by about WIDTH terms.

Defined cases: null text, lang or source is empty text and a group of its own; documents without terms still make their
group; a language whose terms are all rare prices every pair 0; ties go by the UTF-8 of the item; repeated rows and
doc_ids count each; long texts are counted in windows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, materialize, released

#: Documents of a language that a term needs.
LEAST = 10
TOP = 10
UNIT = 1_000_000_000
#: Terms of a shard, on average, and sources of a tile's side, at most about.
WIDTH = 4096
SIDE = 48
#: Distinct terms counted before a task hands them on, and bytes of a text split at a time.
HELD = 300_000
WINDOW = 1 << 20

#: Letters and bytes above ASCII stay, A-Z in lower case; everything else parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        counts, holders, held = {}, {}, 0

        def flush():
            for (lang, source), found in counts.items():
                terms, have = list(found), holders[lang, source]
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array([t.decode() for t in some]), pa.array([found[t] for t in some]), pa.array([have[t] for t in some])]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
            counts.clear()
            holders.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                group = lang, source
                found, have = counts.setdefault(group, Counter()), holders.setdefault(group, Counter())
                before, data, mine, at = len(found), (text.as_py() or "").encode(), set(), 0
                while at < len(data):
                    cut = _GAP.search(data, at + WINDOW)
                    end = cut.start() if cut else len(data)
                    terms = data[at:end].translate(_TERMS).split()
                    found.update(terms)
                    mine.update(terms)
                    at = end
                have.update(mine)
                held += len(found) - before
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return _named(docs).select("lang", "source", "text").mapInArrow(released(run), "lang string, source string, term string, n long, docs long")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


class Trees:
    """Segment trees of equal width over rows of leaves, with equal subtrees as one node."""

    def __init__(self, leaves: np.ndarray):
        """``leaves``: one row of leaf numbers for each tree; their number is a power of two."""
        self.children, ids = [], leaves.astype(np.int64)
        while ids.shape[1] > 1:
            n = int(ids.max()) + 1
            nodes, where = np.unique(ids[:, 0::2] * n + ids[:, 1::2], return_inverse=True)
            self.children.append((nodes // n, nodes % n))
            ids = where.reshape(ids.shape[0], -1)
        self.roots = ids[:, 0]

    def together(self, own: np.ndarray, other: np.ndarray, price_key: np.ndarray):
        """Traversal of pairs of roots, level by level from the top: (key, own node, other node, places, left pair, right pair).

        Pairs that agree in ``price_key`` and in both nodes are one, with the number of their places; at the leaves left and right are None.
        """
        key, a, b, places = _merged(price_key, own, other, np.ones(len(own), np.int64))[:4]
        for left, right in reversed(self.children):
            down = _merged(np.r_[key, key], np.r_[left[a], right[a]], np.r_[left[b], right[b]], np.r_[places, places])
            yield key, a, b, places, down[4][: len(a)], down[4][len(a) :]
            key, a, b, places = down[:4]
        yield key, a, b, places, None, None


def _merged(key, a, b, places):
    """Equal (key, a, b) as one, their places added; last, where each went."""
    n_a, n_b = int(a.max()) + 1, int(b.max()) + 1
    values, where = np.unique((key * n_a + a) * n_b + b, return_inverse=True)
    total = np.zeros(len(values), np.int64)
    np.add.at(total, where, places)
    return values // n_b // n_a, values // n_b % n_a, values % n_b, total, where


def shares(counts: list[int], total: int, n_terms: int) -> np.ndarray:
    """p of each count, in whole numbers of any size."""
    return np.array([1 + UNIT * (c + 2) // (total + 2 * n_terms) for c in counts], np.int64)


def _prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_sums(trees: Trees, p: np.ndarray, own: int, others: np.ndarray) -> np.ndarray:
    """Sum of the prices of one tree against each of ``others``. ``p``: share of each leaf by row; the last leaf is padding."""
    *_, (key, a, b, places, _, _) = trees.together(np.full(len(others), trees.roots[own]), trees.roots[others], np.arange(len(others)))
    pad = p.shape[1]
    real = (a != pad) & (b != pad)
    key, a, b, places = key[real], a[real], b[real], places[real]
    sums = np.zeros(len(others), np.int64)
    np.add.at(sums, key, _prices(p[own, a], p[others[key], b]) * places)
    return sums


def leading_terms(trees: Trees, p: np.ndarray, own: int, whole: int, absent: int, terms: list[str]) -> list[tuple[str, int]]:
    """The TOP terms that row ``own`` has above its share in row ``whole``, with their prices. ``absent`` is the leaf of count 0."""
    levels = list(trees.together(trees.roots[own : own + 1], trees.roots[whole : whole + 1], np.zeros(1, np.int64)))
    _, a, b, places, _, _ = levels[-1]
    pad = p.shape[1]
    real = (a != pad) & (b != pad) & (a != absent)
    best = np.full(len(a), -1, np.int64)
    above, below = p[own, a[real]], p[whole, b[real]]
    best[real] = np.where(above > below, _prices(above, below), -1)
    order = np.argsort(-best, kind="stable")
    enough = np.searchsorted(np.cumsum(places[order]), TOP)
    least = max(0, int(best[order[min(enough, len(order) - 1)]]))
    bests = [best]
    for _, _, _, _, left, right in reversed(levels[:-1]):
        bests.append(np.maximum(bests[-1][left], bests[-1][right]))
    bests.reverse()
    pairs, at = np.flatnonzero(bests[0] >= least), np.zeros(1, np.int64)
    at = at[: len(pairs)]
    for (_, _, _, _, left, right), below in zip(levels[:-1], bests[1:], strict=True):
        pairs, at = np.r_[left[pairs], right[pairs]], np.r_[2 * at, 2 * at + 1]
        live = below[pairs] >= least
        pairs, at = pairs[live], at[live]
    found = sorted((-int(best[k]), terms[i]) for k, i in zip(pairs, at, strict=True))
    return [(term, -f) for f, term in found[:TOP]]


def _tile(part: pd.DataFrame) -> pd.DataFrame:
    """Prices of a tile's pairs, and on the diagonal the leading terms of its sources in this shard."""
    lang, t1, t2 = part["lang"].iat[0], part["t1"].iat[0], part["t2"].iat[0]
    whole = part["terms"].notna().to_numpy()
    part = part.iloc[np.argsort(whole, kind="stable")]  # the language's own row comes last
    n_terms, blocks = int(part["v"].iat[0]), part["block"].to_numpy()
    ids = [np.asarray(x if x is not None else [], np.int64) for x in part["ids"]]
    counts = [np.asarray(x if x is not None else [], np.int64) for x in part["counts"]]
    terms = list(part["terms"].iat[-1]) if whole.any() else []
    size = len(terms) if terms else int(max((i.max() + 1 for i in ids if len(i)), default=0))
    size = max(size, int(part["size"].max()))
    distinct = np.unique(np.concatenate([np.zeros(1, np.int64), *counts]))
    width = 1 << max(0, size - 1).bit_length()
    leaves = np.full((len(part), width), len(distinct), np.int64)
    leaves[:, :size] = 0
    for row, (i, c) in enumerate(zip(ids, counts, strict=True)):
        leaves[row, i] = np.searchsorted(distinct, c)
    trees = Trees(leaves)
    listed = distinct.tolist()
    p = np.stack([shares(listed, int(n), n_terms) for n in part["total"]]) if n_terms else np.ones((len(part), len(listed)), np.int64)
    sources, out = part["source"].tolist(), []
    rows = np.flatnonzero(~np.sort(whole))
    for own in rows:
        others = rows[rows > own] if t1 == t2 else rows[blocks[rows] == t2] if blocks[own] == t1 else rows[:0]
        if len(others):
            sums = pair_sums(trees, p, own, others)
            # rows come in another order in every shard, so a pair's sides are ordered by name before shards are added
            out += [(lang, min(sources[own], sources[j]), "pair", max(sources[own], sources[j]), int(s)) for j, s in zip(others, sums, strict=True)]
        if t1 == t2 and whole.any():
            out += [(lang, sources[own], "term", term, f) for term, f in leading_terms(trees, p, own, len(part) - 1, 0, terms)]
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])


def divergences(docs: DataFrame, least: int = LEAST, width: int = WIDTH, side: int = SIDE) -> DataFrame:
    """lang, source, part, item, value, rank of every group's distances (part pair) and leading terms (part term)."""
    counts = materialize(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs"), "kept-terms")
    groups = materialize(_named(docs).select("lang", "source").distinct(), "groups")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_total")), "lang", "left").fillna(0, ["v", "lang_total"])
    langs = langs.withColumns({"shards": F.greatest(F.lit(1), F.ceil(F.col("v") / F.lit(width))).cast("long"), "blocks": F.ceil(F.col("sources") / F.lit(side)).cast("long")})
    langs = materialize(langs, "langs")

    by_term = F.concat(F.lit("#"), F.col("term"))
    lexicon = join_groups(kept, langs, "lang", "v", kept.count(), by_term).withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    commonest = Window.partitionBy("lang", "shard").orderBy(F.desc("all"), "term")
    lexicon = materialize(lexicon.withColumn("id", F.row_number().over(commonest) - 1), "lexicon")
    cells = counts.select("lang", "source", "term", "n").join(lexicon.select("lang", "term", "shard", "id"), ["lang", "term"])
    cells = cells.groupBy("lang", "shard", "source").agg(F.collect_list(F.struct("id", "n")).alias("cell"), F.sum("n").alias("part_total"))
    cells = materialize(cells, "cells")
    totals = groups.join(cells.groupBy("lang", "source").agg(F.sum("part_total").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])
    sizes = lexicon.groupBy("lang", "shard").agg(F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct("id", "all", "term"))).alias("words"))

    by_source = F.concat(F.lit("#"), F.col("source"))
    rows = join_groups(totals, langs, "lang", "sources", groups.count(), by_source).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    rows = rows.join(cells.select("lang", "shard", "source", "cell"), ["lang", "shard", "source"], "left")
    rows = rows.join(sizes.select("lang", "shard", "size"), ["lang", "shard"], "left").fillna(0, ["size"])
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    layout = lambda block, ids, n, terms: ["block", "size", "v", "total", "source", ids.alias("ids"), n.alias("counts"), terms.alias("terms")]
    tiled = rows.select("*", other).withColumns({"t1": F.least("block", "other"), "t2": F.greatest("block", "other")})
    tiled = tiled.select("lang", "shard", "t1", "t2", *layout("block", F.col("cell.id"), F.col("cell.n"), F.lit(None).cast("array<string>")))
    whole = sizes.join(langs, "lang").select("*", F.col("lang_total").alias("total"), F.lit(None).cast("string").alias("source"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    whole = whole.select("lang", "shard", F.col("block").alias("t1"), F.col("block").alias("t2"), *layout("block", F.col("words.id"), F.col("words.all"), F.col("words.term")))
    priced = tiled.unionByName(whole).groupBy("lang", "shard", "t1", "t2").applyInPandas(_tile, "lang string, source string, part string, item string, value long")
    priced = materialize(priced, "priced")

    pairs = priced.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    terms = priced.filter("part = 'term'").select("*", rank).filter(F.col("rank") <= TOP)
    return pairs.select("*", rank).unionByName(terms)
