"""Conversation structure repair: the cheapest edits by depth-first branch-and-bound, and the damage it is tried on.

A conversation is repaired when the initials of its roles read ``(s?(ua)+)?``. Rows are kept, given the role that is
due, deleted, or preceded by an empty row of the role that is due. ``cheapest_edits`` goes through edits in ASCII order on an
explicit stack. A prefix is left when its cost and the suffix's lower bound (the same problem with the states "after s"
and "after ua" taken as one) exceed the incumbent, when they equal it and the incumbent came earlier in that order, or when its node
(row and state) was reached before at no higher cost: what comes later is greater in ASCII order, so nothing better is lost.
The bound is never more than ten below the optimum, so each node is entered a few times at most.

Two passes over rows in order: the first carries codes and digests and finds the edits, the second streams the texts
past them into the hash. A task holds a few bytes for each row of its longest conversation, never its texts.

Defined cases: a null is one space, in the damage's key as well; all rows of a null conv_id are one conversation; rows of
equal turn are ordered by role, then by SHA-256 of the text, so repeated rows stay adjacent; roles may be any text, those
with other initials cannot be kept; long texts are hashed as they come; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, released

RETYPE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Rows with texts in a batch.
LONG_ROWS = 512
#: A row's code: place of its initial in "sua" (3: another), 4 if it must go, 8 if it is cut off.
MUST_GO, IS_CUT = 4, 8

# States: 0 nothing yet, 1 after s, 2 after u, 3 after ua. _NEXT: by state, what an s, u or a leads to (-1: not allowed).
_NEXT = ((1, 2, -1), (-1, 2, -1), (-1, -1, 3), (-1, 2, -1))
_DUE = (1, 1, 2, 1)
_RELAXED = (0, 1, 2, 1)
_RELAXED_NEXT = ((1, 2, -1), (-1, 2, -1), (-1, -1, 1))
_SPACES = " \t\n\x0b\x0c\r"


def suffix_bounds(codes) -> array:
    """Three lower bounds for each suffix: cost to go from the relaxed states start, u due, a due."""
    n = len(codes)
    bounds = array("q", bytes(24 * (n + 1)))
    after = (0, 0, INSERT)
    bounds[3 * n : 3 * n + 3] = array("q", after)
    for i in range(n - 1, -1, -1):
        code = codes[i]
        own, extra = code & 3, CUT_OFF if code & IS_CUT else 0
        base = []
        for state in range(3):
            least = DELETE + after[state]
            if not code & MUST_GO:
                least = min(least, RETYPE + extra + after[1 if state == 2 else 2])
                to = _RELAXED_NEXT[state][own] if own < 3 else -1
                if to >= 0:
                    least = min(least, extra + after[to])
            base.append(least)
        after = (min(base[0], INSERT + base[2]), min(base[1], INSERT + base[2]), min(base[2], INSERT + base[1]))
        bounds[3 * i : 3 * i + 3] = array("q", after)
    return bounds


def _children(codes, i: int, state: int, cost: int):
    """(row, state, cost, letter) of the edits that may follow, in ASCII order."""
    due = _NEXT[state][_DUE[state]]
    if i == len(codes):
        return [(i, due, cost + INSERT, 73)] if state in (1, 2) else []
    code = codes[i]
    out = [(i + 1, state, cost + DELETE, 68), (i, due, cost + INSERT, 73)]
    if not code & MUST_GO:
        cost += CUT_OFF if code & IS_CUT else 0
        to = _NEXT[state][code & 3] if code & 3 < 3 else -1
        if to >= 0:
            out.append((i + 1, to, cost, 75))
        out.append((i + 1, due, cost + RETYPE, 82))
    return out


def cheapest_edits(codes) -> tuple[int, bytes]:
    """Least cost and, of the edits that have it, the letters that come first in ASCII order."""
    n, bounds = len(codes), suffix_bounds(codes)
    # the first incumbent: go down along the bounds
    i, state, best = 0, 0, 0
    while step := _children(codes, i, state, best):
        i, state, best, _ = min(step, key=lambda c: (c[2] + bounds[3 * c[0] + _RELAXED[c[1]]], -c[0]))
        if i == n and state in (0, 3):
            break
    proven, answer = False, b""
    reached = array("q", [best + 1]) * (4 * (n + 1))
    path, stack = bytearray(), [(0, 0, 0, 0, 0)]
    while stack:
        i, state, cost, depth, letter = stack.pop()
        bound = cost + bounds[3 * i + _RELAXED[state]]
        if bound > best or (proven and bound == best) or reached[4 * i + state] <= cost:
            continue
        reached[4 * i + state] = cost
        if depth:
            del path[depth - 1 :]
            path.append(letter)
        if i == n and state in (0, 3):
            best, proven, answer = cost, True, bytes(path)
            continue
        stack.extend((*child[:3], depth + 1, child[3]) for child in reversed(_children(codes, i, state, cost)))
    return best, answer


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage by the checksum of ``conv_id:turn``."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("harm"))
    rows = rows.filter("harm <> 0").withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"))


def _summaries(batches):
    """Counts and cheapest edits of each conversation, from its marker and its rows in order."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    out, legal = [], {(0, 1), (1, 2), (2, 1)}

    def close():
        cost, audit = cheapest_edits(codes)
        illegal = sum((a & 3, b & 3) not in legal for a, b in zip(codes, memoryview(codes)[1:], strict=False))
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        out.append((conv, gaps, *faults, illegal, cost, audit.decode()))

    codes, started = bytearray(), False
    for batch in batches:
        for is_row, conv_id, turn, code, fault in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if not is_row:
                if started:
                    close()
                started, conv, codes, turns, faults = True, conv_id, bytearray(), None, [0, 0, 0]
                continue
            codes.append(code)
            if fault:
                faults[fault - 1] += 1
            if turn is not None:
                turns = (turns[0], turn, turns[2] + (turn != turns[1])) if turns else (turn, turn, 1)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=names)
            out.clear()
    if started:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 7 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=names)


class Repaired:
    """SHA-256 of a repaired conversation, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.lines = audit, 0, 0, hashlib.sha256(), 0

    def _emit(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._emit("user" if _DUE[self.state] == 1 else "assistant", "")
            self.state = _NEXT[self.state][_DUE[self.state]]
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._emit(role, text)
            self.state = _NEXT[self.state]["sua".index(role[0])]
        elif edit == "R":
            self._emit("user" if _DUE[self.state] == 1 else "assistant", text)
            self.state = _NEXT[self.state][_DUE[self.state]]

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def _hashes(batches):
    """conv_id and its repaired hash, from the marker with the audit and the rows in order."""
    now, conv, out = None, None, []
    for batch in batches:
        for is_row, conv_id, audit, role, text in zip(*(batch.column(i) for i in range(5)), strict=True):
            if is_row.as_py():
                now.row(role.as_py(), text.as_py())
                continue
            if now:
                out.append((conv, head, now.digest()))
            now, conv, head = Repaired(audit["audit"].as_py()), conv_id.as_py(), audit.as_py()
        if out:
            yield _batch(out)
            out = []
    if now:
        yield _batch([(conv, head, now.digest())])


def _batch(rows) -> pa.RecordBatch:
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    columns = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[1][c] for r in rows], pa.int64()) for c in longs), pa.array([r[1]["audit"] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", *longs, "audit", "repaired_sha256"])


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation in ``rows``.

    ``conversations`` (conv_id) adds those that have no row.
    """
    digest = F.unhex(F.sha2("text", 256))
    markers = (rows if conversations is None else conversations).select(F.col("conv_id").cast("long").alias("conv_id"))
    if conversations is not None:
        markers = markers.unionByName(rows.select("conv_id"))
    markers = markers.distinct()
    bare = F.rtrim("text", F.lit(_SPACES))
    cut_off = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    coded = rows.select("conv_id", "turn", "role", digest.alias("digest"), F.lit(True).alias("is_row"), (bare == "").alias("blank"), cut_off.alias("cut_off"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"))]
    coded = coded.unionByName(markers.select("conv_id", *nothing, F.lit(False).alias("is_row"), F.lit(False).alias("blank"), F.lit(False).alias("cut_off")))
    turn = F.col("turn").asc_nulls_first()
    again = F.row_number().over(Window.partitionBy("conv_id", "is_row", "role", "digest").orderBy(turn))
    coded = coded.repartition("conv_id").withColumn("again", again)
    fault = F.when(F.col("blank"), 1).when(F.col("again") > 1, 2).when(F.col("cut_off"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = code + F.when(fault.isin(1, 2), MUST_GO).otherwise(0) + F.when(fault == 3, IS_CUT).otherwise(0)
    ordered = coded.sortWithinPartitions("conv_id", "is_row", turn, "role", "digest", "again")
    found = ordered.select("is_row", "conv_id", "turn", code.alias("code"), fault.alias("fault"))
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    audits = materialize(found.mapInArrow(_summaries, schema), "audits")

    rest = [c for c in audits.columns if c != "conv_id"]
    head = audits.select("conv_id", F.lit(False).alias("is_row"), *nothing[:2], F.struct(*rest).alias("audit"), F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv_id", F.lit(True).alias("is_row"), "turn", "role", F.lit(None).cast(head.schema["audit"].dataType).alias("audit"), "text")
    texts = head.unionByName(texts).repartition("conv_id").withColumn("digest", F.unhex(F.sha2("text", 256)))
    ordered = texts.sortWithinPartitions("conv_id", "is_row", turn, "role", "digest").select("is_row", "conv_id", "audit", "role", "text")
    with arrow_rows(rows.sparkSession, LONG_ROWS):
        return materialize(ordered.mapInArrow(released(_hashes), schema + ", repaired_sha256 string"), "repaired")


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """The rows after damage, repaired; one row for every original conv_id."""
    return repair(damaged(conversations), conversations)
