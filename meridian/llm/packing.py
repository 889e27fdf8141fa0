"""Packing of tokenised documents into fixed-length sequences: first-fit decreasing with a tournament tree.

Each document becomes its token ids and the end id 0, cut into full pieces and one remainder. The
documents are dealt into random groups of about GROUP, the full pieces of long ones one by one; each group packs its own pieces,
longest first, into the first sequence with room, found in a tournament tree of free capacities.

The ids are those of the byte-level BPE tokenizer file with its own settings, whose vocabulary is read as ranks; the tests compare both.

Defined cases: null or empty text is the end id alone; rows are independent, so repeated or null doc_ids
give their own pieces and fall into different groups; a text of any length is encoded whole; ties in length are broken by doc_id, start and checksum; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, released

LENGTH = 1024
GROUP = 4096
#: Rows in a batch of whole documents.
LONG_ROWS = 256
#: Fixed value: the vocabulary's one added token.
SPECIAL = {"<|endoftext|>": 50256}


def encoder():
    """Function from a text to its ids: the vocabulary of byte_bpe_50k.json, read as ranks, which encode several times faster.

    As with the file's own settings, a special token written out in a text is that one id.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def encode(text: str) -> list[int]:
        if any(name in text for name in SPECIAL):
            return encoding.encode(text, allowed_special="all")
        return encoding.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, doc_id, start, length, ids_crc32, doc_tokens: every document cut every ``length`` ids."""

    def run(parts):
        encode = encoder()
        for part in parts:
            rows = []
            for row, doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                ids = memoryview(np.array([*encode(text.as_py()), 0], "<u4").tobytes())
                n = len(ids) // 4
                rows += [(row, doc_id, a, min(length, n - a), zlib.crc32(ids[4 * a : 4 * (a + length)]), n) for a in range(0, n, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 6, names=names)

    names = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(released(run), "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class TournamentTree:
    """Free capacity of bins in order; finds the first bin with enough room in log time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Bin of the item and the room it had."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        room = free[at]
        free[at] = room - size
        where = at - self.leaves
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        return where, room


def _pack_group(length: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part["doc_id"] = part["doc_id"].astype("Int64")
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        tree = TournamentTree(len(part), length)
        placed = [tree.place(n) for n in part["length"].tolist()]
        base = int(part["pack_group"].iat[0]) << 32
        part["sequence_id"] = [base + where for where, _ in placed]
        part["offset"] = [length - room for _, room in placed]
        return part.drop(columns="pack_group")

    return run


def pack(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Pieces with sequence_id and offset; groups are independent, so their number grows with the input."""
    groups = max(1, docs.count() // group)
    # a document's remainder goes by the document; its full pieces, which fill a sequence each, may go anywhere
    full = F.when(F.col("length") == length, F.col("start")).otherwise(-1)
    dealt = pieces(docs, length).withColumn("pack_group", F.pmod(F.xxhash64("row", full), F.lit(groups))).drop("row")
    with arrow_rows(docs.sparkSession, LONG_ROWS):
        dealt = materialize(dealt, "pieces")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInPandas(_pack_group(length), schema)
