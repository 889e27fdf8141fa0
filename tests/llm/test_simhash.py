"""SimHash groups against brute force, the code's properties, and odd tables."""

from collections import Counter

import numpy as np
import pytest
import xxhash

from meridian.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp long, key long, size string"


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for r, x in zip(rows, label, strict=True):
        if r[0] is not None:
            least[x] = min(least.get(x, r[0]), r[0])
    return Counter((r[0], f"{f:016x}", least.get(x)) for r, f, x in zip(rows, fps, label, strict=True))


def texts(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = [None, "", " \n\t\x0b", "One", "one TWO", "a b c d", "A  B\nC D", "日本 語 テキスト x y", "É É É É", "x y z w " * 300]
    for _ in range(5):
        base = texts(rng, 400).split()
        out.append(" ".join(base))
        for k in range(30):
            w = list(base)
            w[rng.integers(400)] = f"new{k}"
            out.append(" ".join(w))
    out += [out[10]] * 40
    return [(i, t, "en", None, 5, "x") for i, t in enumerate(out)] + [(None, out[12], None, None, None, None), (7, out[7], "e", 1, 1, "s"), (None, "only here is this text", "", 0, 0, "")]


@pytest.mark.parametrize(("block", "small", "window"), [(1024, 16, 1 << 20), (4, 2, 64)])
def test_groups_equal_brute_force(spark, rows, monkeypatch, block, small, window):
    """With production sizes, and with groups split into tiles, stars of each linked set and texts in windows."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "WINDOW", window)
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.BITS, block))
    got = simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "fingerprint", "component_id")
    want = brute(rows)
    assert Counter(map(tuple, got.collect())) == want
    assert len({x[2] for x in want}) < len(want) - 40


def test_windows_keep_every_shingle(monkeypatch):
    rng = np.random.default_rng(2)
    long = [texts(rng, 20_000), "word" * 50_000, " \n " * 9000 + "tail", "a" + " " * 5000 + "b c d e"]
    whole = [simhash.fingerprint(t) for t in long]
    assert whole == [brute_fingerprint(t) for t in long]
    monkeypatch.setattr(simhash, "WINDOW", 50)
    assert [simhash.fingerprint(t) for t in long] == whole


def test_empty_and_null_tables(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    one = simhash.simhash_groups(spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.fingerprint, r.component_id, r.class_size) for r in one] == [(None, "0" * 16, None, 2)] * 2


def test_code_and_lists():
    code = simhash.codewords()
    assert len(set(code.tolist())) == 4096 and min(int(c).bit_count() for c in code[1:]) == 7
    starts, near, nearest = simhash.decoding()
    assert set((starts[1:] - starts[:-1]).tolist()) == {1, 6}
    rng = np.random.default_rng(3)
    for word in rng.integers(0, 1 << 16, 50):
        away = np.bitwise_count(code ^ np.uint32(word))
        assert near[starts[word] : starts[word + 1]].tolist() == np.flatnonzero(away <= 4).tolist() and away[nearest[word]] <= 3


def test_keys_meet_within_four_bits():
    """Every pair at one to four differing bits shares a key of its own kind."""
    rng, tables = np.random.default_rng(4), simhash.decoding()
    x = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 1 + i % 4, replace=False)) for i in range(len(x))], np.uint64)
    shared = []
    for side in (x, x ^ flips):
        keys, owners = simhash.fuzzy_keys(side, tables)
        shared.append(set(zip(owners.tolist(), keys.tolist(), strict=True)))
    both = np.array(sorted(shared[0] & shared[1]))
    fine = simhash._first_of_kind(both[:, 1], flips[both[:, 0]])
    assert len(set(both[fine, 0].tolist())) == len(x)


def test_components_of_chains_and_hubs(spark):
    edges = [(i + 1, i) for i in range(1, 60)] + [(100 + i, 99) for i in range(1, 80)] + [(-1, -5)]
    got = {r.id: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {100 + i: 99 for i in range(1, 80)} | {-1: -5}
