"""Conversation repair against a plain recursion over suffixes, and odd tables."""

import hashlib
import re
import time
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from meridian.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, digest long"
EMPTY = hashlib.sha256(b"").hexdigest()


def best_edits(rows):
    """Least (cost, audit) and repaired lines of rows (role, text, must go, cut off), by recursion over suffixes."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def go(i, state, inserted=0):
        options = []
        due, role = ("a", "assistant") if state == "u" else ("u", "user")
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserted < 2:
            cost, audit, lines = go(i, due, inserted + 1)
            options.append((cost + 5, "I" + audit, (f"{role}:", *lines)))
        if i < len(rows):
            r, text, gone, cut = rows[i]
            cost, audit, lines = go(i + 1, state)
            options.append((cost + 2, "D" + audit, lines))
            if not gone:
                extra = 5 if cut else 0
                cost, audit, lines = go(i + 1, due)
                options.append((cost + 1 + extra, "R" + audit, (f"{role}:{text}", *lines)))
                if (state, r[:1]) in after:
                    cost, audit, lines = go(i + 1, after[state, r[:1]])
                    options.append((cost + extra, "K" + audit, (f"{r}:{text}", *lines)))
        return min(options, default=(10**9, "~", ()))

    return go(0, "")


def brute(table):
    """Rows of the contract for (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in (r[:4] for r in table if r[0] == conv):
            harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            rows += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, judged, faults = set(), [], Counter()
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = best_edits(tuple(judged))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, table):
    got = repair.damage_and_repair(spark.createDataFrame(table, SCHEMA)).collect()
    want = brute(table)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


def test_conversations_equal_recursion(spark):
    rng = np.random.default_rng(1)
    table = []
    for conv in range(120):
        for turn in range(rng.integers(1, 12)):
            role = rng.choice(["user", "assistant", "system", "tool", "", "ursula"], p=[0.4, 0.35, 0.1, 0.05, 0.05, 0.05])
            text = rng.choice(["Well. ", "What?\n", "no end", "Stop!", "  ", "", "same.", "é "])
            table.append((conv, turn, str(role), f"{text}{turn if rng.random() < 0.5 else ''}", "x", None))
    check(spark, table)


def test_odd_rows(spark):
    """Nulls in every column, equal turns, repeated rows, conversations without rows left, and long texts."""
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    table = [(None, None, None, None, None, None), (None, None, "user", "Hi.", None, 1), (None, 3, "assistant", "Yes.", None, 1), (None, 3, "assistant", "Yes.", None, 1)]
    table += [(gone, 1, "user", "Hi.", "a", 0), (-5, None, "user", None, "a", 0), (-5, 2, None, "b.", "a", 0), (-6, 9, "user", "z.", "", 0), (-6, 9, "user", "a.", "", 0), (-6, 9, "assistant", "z.", "", 0)]
    table += [(77, t, "user" if t % 2 else "assistant", "word " * 200_000 + "end" + "." * (t % 3), "", 0) for t in range(6)]
    table += [(78, t, "user" if t % 2 else "assistant", f"line {t}.", "", 0) for t in range(300)]
    check(spark, table)
    rows = {r.conv_id: r for r in repair.damage_and_repair(spark.createDataFrame(table, SCHEMA)).collect()}
    assert tuple(rows[gone])[1:] == (0, 0, 0, 0, 0, 0, "", EMPTY)


def test_empty_table(spark):
    assert repair.damage_and_repair(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("kinds", [[0, 1, 2, 3], [1], [0], [2], [3], [1, 2], [0, 1]])
def test_search_is_exact_and_linear(kinds):
    """Edits equal the recursion's; a long conversation of any kind takes a bounded number of steps a row."""
    rng = np.random.default_rng(2)
    for n in range(9):
        for _ in range(40):
            codes = bytes(int(rng.choice(kinds)) + int(rng.choice([0, 0, 4, 8])) for _ in range(n))
            rows = tuple(("suat"[c & 3], "", bool(c & 4), bool(c & 8)) for c in codes)
            cost, audit = repair.cheapest_edits(codes)
            assert (cost, audit.decode()) == best_edits(rows)[:2]
    began = time.process_time()
    codes = bytes(int(rng.choice(kinds)) + (8 if rng.random() < 0.05 else 0) for _ in range(50_000))
    cost, audit = repair.cheapest_edits(codes)
    assert len(audit) >= 50_000 and time.process_time() - began < 30
