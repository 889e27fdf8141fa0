"""Language identification by prediction by partial matching (PPM).

Per language, a variable-order byte context tree holds the counts of every context of up to ``order``
bytes. Coding a byte starts at the longest context; an unseen byte pays the escape probability
D / (T + D) (method C: D distinct successors, T occurrences) and drops to the next shorter one, down to
a uniform byte. The statistics are frozen after fitting, so the code length of a text under each
language is an exact sum over its bytes, and the language with the shortest code wins.

The fit reads a sample of the labelled rows of at most about ``max_bytes`` bytes a language
(MAX_BYTES), chosen by a hash of the text. Everything else covers whole texts of all rows.

Defined cases: ``und`` with score 0 for a null text, a text without a letter, or when nothing was
learned; ties go to the first language in sorted order; null lang rows are not learned from; a null
doc_id counts as not held out and is not learned from; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_rows, materialize, released

ORDER = 3
MAX_BYTES = 4_000_000
MAX_BITS_PER_BYTE = 5.0
#: Rows in a batch of whole documents.
LONG_ROWS = 256
_WINDOW = 1 << 20


class GramIndex:
    """Open-addressing hash index from gram codes to consecutive numbers."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = max(8, int(4 * max(1, len(codes)) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(codes), dtype=np.int32)
        at = self._home(codes)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            again = self.slots[at] != left
            left, at = left[again], (at[again] + 1) & ((1 << self.bits) - 1)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Number of each code, -1 if it has none."""
        at = self._home(codes)
        out = self.slots[at]
        if not len(self.codes):
            return out
        open_ = np.flatnonzero((out >= 0) & (self.codes[out] != codes))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.slots[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.codes[out[open_]] != codes[open_])]
        return out


def gram_codes(data: np.ndarray, order: int) -> np.ndarray:
    """Code of the (order + 1)-byte gram that ends at each byte after the first ``order``."""
    code = np.zeros(len(data) - order, np.uint64)
    for k in range(order + 1):
        code = (code << np.uint64(8)) | data[k : k + len(code)]
    return code


def padded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after ``order`` zero bytes, and where each text's bytes start."""
    pad = bytes(order)
    data = np.frombuffer(b"".join(pad + t for t in texts) or pad, np.uint8)
    sizes = np.fromiter((len(t) + order for t in texts), np.int64, len(texts))
    return data, np.cumsum(sizes) - sizes


class ContextTrees:
    """The frozen trees of all languages as tables from grams to code lengths in bits."""

    def __init__(self, grams: pd.DataFrame, langs: list[str], order: int):
        self.langs, self.order = langs, order
        n = len(langs)
        code, lang, count = (grams[c].to_numpy() for c in ("gram", "lang", "n"))
        code, self.levels = code.astype(np.uint64), []
        shorter = None
        for k in range(order + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            codes, of = np.unique(code & mask, return_inverse=True)
            counts = np.zeros((len(codes), n))
            np.add.at(counts, (of, lang), count)
            contexts, of_context = np.unique(codes >> np.uint64(8), return_inverse=True)
            # the leading byte is dropped for the successor; the context is all but the last byte
            total, distinct = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, of_context, counts)
            np.add.at(distinct, of_context, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                hit = -np.log2(counts / (total + distinct)[of_context])
            if shorter is None:
                back = np.full((len(codes), n), 8.0)
            else:
                index, bits = shorter
                back = bits[index.find(codes & np.uint64((1 << 8 * k) - 1))]
            bits = np.where(counts > 0, hit, escape[of_context] + back)
            shorter = GramIndex(codes), bits
            self.levels.append((shorter[0], bits.astype(np.float32), GramIndex(contexts), escape.astype(np.float32)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte, one column a language."""
        index, bits, _, _ = self.levels[self.order]
        at = index.find(codes)
        out = bits[at]
        left = np.flatnonzero(at < 0)
        if len(left):
            out[left] = 0
        for k in range(self.order, -1, -1):
            if not len(left):
                break
            _, _, contexts, escape = self.levels[k]
            code = codes[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            seen = contexts.find(code >> np.uint64(8))
            out[left[seen >= 0]] += escape[seen[seen >= 0]]
            if k == 0:
                out[left] += 8.0
                break
            index, bits, _, _ = self.levels[k - 1]
            at = index.find(code & np.uint64((1 << 8 * k) - 1))
            out[left[at >= 0]] += bits[at[at >= 0]]
            left = left[at < 0]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits to code each whole text, one column a language."""
        data, starts = padded(texts, self.order)
        out = np.zeros((len(texts), len(self.langs)))
        codes_left = len(data) - self.order
        for a in range(0, codes_left, _WINDOW):
            bits = self.bits(gram_codes(data[a : min(a + _WINDOW, codes_left) + self.order], self.order)).astype(np.float64)
            # a gram belongs to the text whose padding it starts after or in; grams over a text's end are dropped
            first = np.searchsorted(starts, a, "right") - 1
            last = np.searchsorted(starts, a + len(bits), "left")
            for i in range(first, last):
                end = starts[i] + len(texts[i])
                lo, hi = max(starts[i], a) - a, min(end, a + len(bits)) - a
                if hi > lo:
                    out[i] += bits[lo:hi].sum(axis=0)
        return out


def _count_grams(order: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts):
        for part in parts:
            for lang, rows in part.groupby("lang"):
                texts = [t.encode() for t in rows["text"]]
                data, starts = padded(texts, order)
                codes = gram_codes(data, order)
                ends = starts + np.fromiter(map(len, texts), np.int64, len(texts))
                inside = np.zeros(len(codes) + 1, np.int64)
                np.add.at(inside, np.minimum(starts, len(codes)), 1)
                np.add.at(inside, np.minimum(ends, len(codes)), -1)
                gram, n = np.unique(codes[np.cumsum(inside[:-1]) > 0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.astype(np.int64), "n": n})

    return run


def fit(labelled: DataFrame, order: int = ORDER, max_bytes: int = MAX_BYTES) -> ContextTrees:
    """Trees from rows (text, lang); a language longer than ``max_bytes`` is sampled down to about that."""
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select(F.lower("text").alias("text"), "lang")
    sizes = {r["lang"]: r["size"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    langs = sorted(sizes)
    if not langs:
        return ContextTrees(pd.DataFrame({"gram": [], "lang": [], "n": []}).astype("int64"), [], order)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, max_bytes / max(1, sizes[lang])))])
    number = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    parts = sample.select("text", number[F.col("lang")].alias("lang")).mapInPandas(released(_count_grams(order)), "lang long, gram long, n long")
    return ContextTrees(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas(), langs, order)


def predict(docs: DataFrame, trees: ContextTrees, columns: list, prefix: str = "") -> DataFrame:
    """``columns`` of ``docs`` with lang_pred, score and bits_per_byte, whose names get the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        trees = shared.value
        for batch in batches:
            n = batch.num_rows
            pred, score, rate = ["und"] * n, np.zeros(n), np.zeros(n)
            letters = batch.column(batch.num_columns - 1).to_pylist()
            rows = [i for i in range(n) if letters[i]] if trees.langs else []
            text = batch.column(batch.num_columns - 2)
            for at in _by_size(rows, text):
                texts = [text[i].as_py().encode() for i in at]
                bits = trees.code_lengths(texts)
                low = bits.min(axis=1)
                for i, k in zip(at, bits.argmin(axis=1), strict=True):
                    pred[i] = trees.langs[k]
                score[at] = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
                rate[at] = low / np.fromiter(map(len, texts), float, len(texts))
            kept = batch.columns[: batch.num_columns - 2]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pred), pa.array(score), pa.array(rate)], names=names)

    letter = F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False))
    kept = docs.select(*columns).schema
    schema = StructType([*kept.fields, *[StructField(prefix + n, t()) for n, t in (("lang_pred", StringType), ("score", DoubleType), ("bits_per_byte", DoubleType))]])
    names = [f.name for f in schema]
    return docs.select(*columns, F.lower(docs["text"]).alias("ppm text"), letter.alias("ppm letter")).mapInArrow(released(run), schema)


def _by_size(rows: list[int], text, most: int = 1_000_000) -> Iterator[list[int]]:
    """Runs of rows of about ``most`` bytes, to bound what a worker holds at once."""
    at, size = [], 0
    for i in rows:
        at.append(i)
        size += len(text[i].as_buffer())
        if size >= most:
            yield at
            at, size = [], 0
    if at:
        yield at


def held_out(folds: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every document, learning from fold 1 to 4 of 5."""
    learn = docs.filter(~held_out(5) & F.col("doc_id").isNotNull())
    rows = docs.select("doc_id", held_out(5).alias("held_out"), "text")
    return predict(rows, fit(learn), ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, max_bits_per_byte: float = MAX_BITS_PER_BYTE) -> DataFrame:
    """Documents without those rejected: ``und``, or coded worse than ``max_bits_per_byte`` by every language."""
    learn = docs.filter(~held_out(5) & F.col("doc_id").isNotNull())
    out = predict(docs, fit(learn), [docs[c] for c in docs.columns], prefix="ppm ")
    out = out.filter((F.col("ppm lang_pred") != "und") & (F.col("ppm bits_per_byte") <= max_bits_per_byte)).select(*docs.columns)
    with arrow_rows(docs.sparkSession, LONG_ROWS):
        return materialize(out, "identified")
