"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The text gets a leading space, spaces become the marker U+2581, and the segmentation with the largest
sum of log scores wins. A character without a piece costs PENALTY below the least score and becomes its UTF-8
bytes as byte pieces. Decoding joins the pieces, turns markers into spaces and drops the leading one.

The vocabulary file is a BPE model whose scores are ranks only; they become log probabilities by Zipf's
law, -ln(rank + 1) - ln(sum of 1 / (r + 1)). No piece holds a marker after another character or a newline
beside one (checked when the trie is built), so a text is cut there and equal parts are encoded once.

Defined cases: null text is empty and has no pieces; ties go to the longer last piece; a text's own U+2581
decodes to a space; rows are independent, so repeated or null doc_ids are kept; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PENALTY = 10.0
CACHE = 400_000
_PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class DoubleArray:
    """Trie over bytes: the child of node s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 17
        self.base, self.check, self.value = (np.full(size, -1, np.int32) for _ in range(3))
        used = bytearray(size)
        used[0] = 1
        self.check[0] = 0
        stack, first_free = [(0, 0, len(order), 0)], 1
        while stack:
            node, lo, hi, depth = stack.pop()
            if lo < hi and len(keys[order[lo]]) == depth:
                self.value[node] = order[lo]
                lo += 1
            children, at = [], lo
            while at < hi:
                c, start = keys[order[at]][depth], at
                while at < hi and keys[order[at]][depth] == c:
                    at += 1
                children.append((c, start, at))
            if not children:
                continue
            base = max(0, first_free - children[0][0] - 1)
            begun = base
            while base + 300 < len(used) and any(used[base + c + 1] for c, _, _ in children):
                base += 1
            if base + 300 >= len(used):
                used.extend(bytes(len(used)))
                self.base, self.check, self.value = (np.concatenate([x, np.full(len(x), -1, np.int32)]) for x in (self.base, self.check, self.value))
                stack.append((node, lo, hi, depth))
                continue
            if base - begun > 50:  # the region before is nearly full
                first_free = base
            self.base[node] = base
            for c, start, end in children:
                used[base + c + 1] = 1
                self.check[base + c + 1] = node
                stack.append((base + c + 1, start, end, depth + 1))

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The children, -1 where there is none."""
        to = self.base[node].astype(np.int64) + byte + 1
        to = np.where(self.base[node] >= 0, np.minimum(to, len(self.check) - 1), 0)
        return np.where((self.check[to] == node) & (to > 0), to, -1)


class Pieces:
    """A vocabulary with its trie; encodes and decodes whole texts."""

    def __init__(self, names: list[str], is_byte: list[bool], is_special: list[bool]):
        self.names = names
        plain = [i for i in range(len(names)) if not is_byte[i] and not is_special[i]]
        held = [names[i] for i in plain]
        if any(re.search(f"[^{MARK}]{MARK}", p) or ("\n" in p and len(p) > 1) for p in held):
            raise ValueError("a piece crosses a cut")
        self.trie = DoubleArray([p.encode() for p in held])
        total = math.log(sum(1 / (r + 1) for r in range(len(held))))
        self.scores = np.full(len(names), 0.0)
        self.scores[plain] = [-math.log(r + 1) - total for r in range(len(held))]
        self.ids = np.array(plain, np.int64)
        self.unknown = float(self.scores.min()) - PENALTY
        self.first_byte = is_byte.index(True)
        self.bytes = [bytes([int(n[1:-1], 16)]) if b else b"" if s else n.encode() for n, b, s in zip(names, is_byte, is_special, strict=True)]
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        return cls([model.id_to_piece(i) for i in n], [model.is_byte(i) for i in n], [model.is_control(i) or model.is_unknown(i) for i in n])

    def segment(self, units: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of each unit by Viterbi, all units in lockstep."""
        order = sorted(range(len(units)), key=lambda i: -len(units[i]))
        out: list[bytes] = [b""] * len(units)
        at = 0
        while at < len(order):
            width = max(1, len(units[order[at]]))
            group = order[at : at + max(1, min(20_000, 4_000_000 // width))]
            at += len(group)
            for i, ids in zip(group, self._lockstep([units[i] for i in group]), strict=True):
                out[i] = ids
        return out

    def _lockstep(self, units: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        width = int(sizes[0])
        data = np.zeros((len(units), width + 1), np.uint8)
        flat = np.frombuffer(b"".join(units), np.uint8)
        data[np.repeat(np.arange(len(units)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        best = np.full((len(units), width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((len(units), width + 1), np.int32)
        piece = np.full((len(units), width + 1), -1, np.int32)
        for i in range(width):
            live = np.searchsorted(-sizes, -i, "left")  # units longer than i, as they are sorted by size
            rows = np.flatnonzero(best[:live, i] > -np.inf)
            if not len(rows):
                continue
            lead = data[rows, i]
            char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            alone = np.zeros(len(rows), bool)
            node, walk, j = np.zeros(len(rows), np.int64), np.arange(len(rows)), i
            while len(walk):
                inside = j < sizes[rows[walk]]
                walk, node = walk[inside], node[inside]
                node = self.trie.step(node, data[rows[walk], j].astype(np.int64))
                walk, node = walk[node >= 0], node[node >= 0]
                if not len(walk):
                    break
                j += 1
                value = self.trie.value[node]
                hit = value >= 0
                who, what = walk[hit], value[hit]
                alone[who[char[who] == j - i]] = True
                score = best[rows[who], i] + self.scores[self.ids[what]]
                better = score >= best[rows[who], j]
                better &= (score > best[rows[who], j]) | (back[rows[who], j] > i)
                who, what, score = who[better], what[better], score[better]
                best[rows[who], j], back[rows[who], j], piece[rows[who], j] = score, i, self.ids[what]
            lone = np.flatnonzero(~alone)
            end = np.minimum(i + char[lone], sizes[rows[lone]])
            score = best[rows[lone], i] + self.unknown
            better = score > best[rows[lone], end]
            lone, end, score = lone[better], end[better], score[better]
            best[rows[lone], end], back[rows[lone], end], piece[rows[lone], end] = score, i, -1
        out = []
        for k, unit in enumerate(units):
            ids, j = [], len(unit)
            while j:
                i = back[k, j]
                ids += [piece[k, j]] if piece[k, j] >= 0 else [self.first_byte + c for c in reversed(unit[i:j])]
                j = i
            out.append(np.array(ids[::-1], "<u4").tobytes())
        return out

    def parts(self, text: str) -> list[str]:
        """The text's cuts, each without the marker it begins with."""
        parts = text.split(" ")
        if "" in parts:
            parts = [p[1:] for p in _PARTS.findall(MARK + text.replace(" ", MARK))]
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        cut = [self.parts(t) if t else [] for t in texts]
        new = list({p for parts in cut for p in parts} - self.known.keys())
        lines = [(MARK + p).split("\n") for p in new]
        units = {u: b"" for line in lines for u in line if u} | {"\n": b""}
        units = dict(zip(units, self.segment([u.encode() for u in units]), strict=True))
        for p, line in zip(new, lines, strict=True):
            self.known[p] = units["\n"].join(units[u] if u else b"" for u in line)
        return [b"".join(map(self.known.__getitem__, parts)) for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text.replace(MARK, " ")[1:]


def encode_documents(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, log_score, decoded_sha256 of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "log_score", "decoded_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]

    def run(batches):
        model = shared.value
        byte = np.zeros(len(model.names), bool)
        byte[model.first_byte : model.first_byte + 256] = True
        scores = np.where(byte, 0.0, model.scores)

        def digest(doc_id, text, coded):
            ids = np.frombuffer(coded, "<u4")
            n_byte, decoded = int(byte[ids].sum()), model.decode(ids)
            fallen = sum(1 for c in _byte_runs(ids, byte, model))
            return doc_id, len(ids), n_byte, zlib.crc32(coded), float(scores[ids].sum()) + fallen * model.unknown, hashlib.sha256(decoded.encode()).hexdigest()

        for batch in batches:
            doc_ids, rows, texts, size = batch.column(0).to_pylist(), [], [], 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py())
                size += len(texts[-1])
                if size > 4_000_000 or i + 1 == batch.num_rows:
                    ids = doc_ids[i + 1 - len(texts) : i + 1]
                    rows += map(digest, ids, texts, model.encode(texts))
                    texts, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, log_score double, decoded_sha256 string")


def _byte_runs(ids: np.ndarray, byte: np.ndarray, model: Pieces) -> list[int]:
    """The byte pieces that begin a character."""
    at = ids[byte[ids]] - model.first_byte
    return at[(at & 0xC0) != 0x80].tolist()
