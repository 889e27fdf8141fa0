"""Source divergences against brute force, tree sharing, and odd tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from meridian.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value double"
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows):
    groups, holders = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        text, lang, source = (x or "" for x in r[1:4])
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in LETTERS.findall(text)]
        groups[lang, source].update(words)
        holders[lang].update(set(words))
    out = []
    for lang in {k[0] for k in groups}:
        terms = [t for t, n in holders[lang].items() if n >= 10]
        mine = {s: c for (x, s), c in groups.items() if x == lang}
        whole = sum(mine.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in terms) + 2 * len(terms))  # noqa: B023

        p = {s: {t: share(c, t) for t in terms} for s, c in mine.items()}
        q = {t: share(whole, t) for t in terms}
        for s in mine:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in terms), o.encode(), o) for o in mine if o != s]
            tops = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode(), t) for t in terms if mine[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(tops)[:10])):
                out += [(lang, s, part, item, -f, k) for k, (f, _, item) in enumerate(found, 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Éa", "éa", "ÉA", "ünd", "日本", "Tie", "tie"]
    out = []
    for i in range(260):
        lang, source = ["en", "fr", "de"][i % 3], f"src{i % 11 if i % 4 else 0}"
        skew = rng.dirichlet(np.full(len(words), 0.3 + (i % 11) / 10))
        out.append((i, " ".join(rng.choice(words, rng.integers(0, 60), p=skew)).replace(" ", str(i % 10), 3), lang, source, "x", 1, 0.5))
    out += [(1, out[1][1], "en", "src0", None, None, None)] * 12 + [(None, None, None, None, None, None, None), (5, "one", "", None, "", 0, 0.0), (6, "", "en", "empty", "", 0, 0.0), (7, "rare words only", "it", "a", "", 0, 0.0), (8, "1 2 3", "it", "b", "", 0, 0.0)]
    return [*out, (9, "wa " * 500_000 + "x" * 70_000 + " waa", "fr", "long", "", 0, 0.0)]


@pytest.mark.parametrize(("width", "side", "held", "window"), [(4096, 48, 300_000, 1 << 20), (8, 2, 3, 16)])
def test_divergences_equal_brute_force(spark, rows, monkeypatch, width, side, held, window):
    """With production sizes, and with many shards, tiles, flushes and windows."""
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "WINDOW", max(window, 1024))
    got = divergence.divergences(spark.createDataFrame(rows, SCHEMA), width=width, side=side).select("lang", "source", "part", "item", "value", "rank")
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_pairs_of_shards_that_list_sources_in_other_orders(spark, rows):
    """As with larger tables, no broadcasts and no coalesced partitions: the sources of a tile come in another order in every shard."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        got = divergence.divergences(spark.createDataFrame(rows, SCHEMA), width=8).collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert Counter(map(tuple, got)) == brute(rows)


def test_ties_and_small_tables(spark):
    assert divergence.divergences(spark.createDataFrame([], SCHEMA)).count() == 0
    table = [(i, "b a c d e f g h i j k l", "en", f"s{i % 2}", "", 0, 0.0) for i in range(24)] + [(99, "a b c d e f g h i j k l", "en", "t", "", 0, 0.0)]
    got = divergence.divergences(spark.createDataFrame(table, SCHEMA), width=4).collect()
    assert Counter(map(tuple, got)) == brute(table)


def test_equal_pairs_are_priced_once():
    """Two trees of 4096 leaves with few distinct counts: far fewer pairs than places at every level, and the same sums."""
    rng = np.random.default_rng(2)
    leaves = np.zeros((3, 4096), np.int64)
    leaves[:, :40] = rng.integers(0, 4, (3, 40))
    leaves[2] = leaves[1]
    trees = divergence.Trees(leaves)
    assert trees.roots[1] == trees.roots[2] != trees.roots[0]
    levels = list(trees.together(trees.roots[:1], trees.roots[1:2], np.zeros(1, np.int64)))
    assert len(levels) == 13 and all(level[3].sum() == 1 << i for i, level in enumerate(levels))
    assert max(len(level[1]) for level in levels) < 60
    p = np.stack([divergence.shares([0, 1, 2, 3], n, 4096) for n in (50, 60, 70)])
    a, b = p[0][leaves[0]], p[1][leaves[1]]
    assert divergence.pair_sums(trees, p, 0, np.array([1, 2]))[0] == ((a - b) ** 2 // (a + b)).sum()


def test_shares_of_large_counts():
    assert divergence.shares([10**15], 10**15 + 5, 2).tolist() == [1 + 10**9 * (10**15 + 2) // (10**15 + 9)]
