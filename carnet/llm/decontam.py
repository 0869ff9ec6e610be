"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by the windows of every document.

A word is a run of ASCII letters and digits or non-ASCII characters, A-Z in lower case. A window is ``n`` consecutive words of an
item; an item of fewer words, but not none, is one window. Words of a document inside an occurrence of a window are hit.

The set of windows goes to the workers only up to ``max_bytes`` of item text. A larger set is dealt into slices by hash, each within
the bound, and the documents are scanned once per slice; their hits are merged, so the result does not depend on the slicing.

Defined cases: a null or empty text has no words and no hits; items without words match nothing; equal items or items that share
windows are all named; an item without an id is looked for, but named nowhere; an empty table of items hits nothing.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet.llm.common import fresh, text_bytes
from carnet.session import cut_lineage

WINDOW = 10
MAX_BYTES = 32 << 20
#: Share of hit words from which :func:`decontaminate` removes the document instead of its spans.
DROP_SHARE = 0.5
#: Stands where a span was cut out; a word of its own, which no item may hold.
GAP = " \u2026 "

HITS = "struct<n_words: long, hits: array<struct<lo: long, hi: long>>, items: array<string>>"

# Bytes that are no part of a word become blanks; capitals become small letters.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of a text in UTF-8."""
    return text.translate(_NORMAL).split()


class _Codes(dict):
    """Word -> code; words of no item have code 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


class WindowSet:
    """Windows of a bounded set of items: exact texts, and per length the sorted rolling hashes that find candidates."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.exact: dict[bytes, set[str]] = {}
        self.codes = _Codes()
        sizes: dict[int, set[bytes]] = {}
        for name, text in items:
            words = words_of(text)
            size = min(n, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                key = b" ".join(words[i:i + size])
                self.exact.setdefault(key, set()).update([name] if name is not None else [])
                sizes.setdefault(size, set()).add(key)
            for word in words:
                self.codes.setdefault(word, len(self.codes) * 2 + 1)
        self.sorted = {size: np.sort(np.concatenate([self.rolling(self.encode(k.split(b" ")), size) for k in keys])) for size, keys in sizes.items()}

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.codes.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def rolling(codes: np.ndarray, size: int) -> np.ndarray:
        """Polynomial hash of every window of ``size`` codes, modulo 2^64."""
        total = np.zeros(len(codes) - size + 1, np.uint64)
        for i in range(size):
            total = total * _FACTOR + codes[i:len(total) + i]
        return total

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [lo, hi) ranges of hit words, and the names of the items found there."""
        codes = self.encode(words)
        known = np.concatenate(([0], np.cumsum(codes != 0)))
        spans, names = [], set()
        for size, table in self.sorted.items():
            if len(words) < size:
                continue
            whole = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(whole):
                continue
            hashes = self.rolling(codes, size)[whole]
            at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
            for i in whole[table[at] == hashes].tolist():
                found = self.exact.get(b" ".join(words[i:i + size]))
                if found is not None:
                    spans.append((i, i + size))
                    names |= found
        return merged(spans), names


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cut(text: bytes, spans: list[tuple[int, int]], gap: bytes) -> bytes:
    """The text with the words of each range, and what stands between them, replaced by ``gap``. Bytes and words run in step."""
    blank = text.translate(_NORMAL)
    starts, ends, at = [], [], 0
    for word in blank.split():
        at = blank.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    kept, last = [], 0
    for lo, hi in spans:
        kept.extend((text[last:starts[lo]], gap))
        last = ends[hi - 1]
    return b"".join([*kept, text[last:]])


def _finder(windows, text: Column, before: Column) -> Column:
    @F.arrow_udf(HITS)
    def find(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        out = []
        for raw, prior in zip(texts, earlier.to_pylist()):
            words = words_of(raw.as_py())
            spans, names = windows.value.find(words) if words else ([], set())
            if prior:
                spans = merged(chain(spans, ((s["lo"], s["hi"]) for s in prior["hits"])))
                names |= set(prior["items"])
            out.append({"n_words": len(words), "hits": [{"lo": lo, "hi": hi} for lo, hi in spans], "items": sorted(names)})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("items", pa.list_(pa.string()))]))

    return find.asNondeterministic()(text, before)


def slices(items: DataFrame, item_id: str, text: str, n: int, max_bytes: int):
    """Window sets of the items, each of at most about ``max_bytes`` of text, read one at a time. An item longer than the bound is a
    slice of its own; the checked size is that of the table, so nothing larger is ever collected or broadcast."""
    rows = items.select(F.col(item_id).cast("string").alias("id"), text_bytes(F.col(text)).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-2 * total // max_bytes) if total > max_bytes else 1
    for part in range(parts):
        mine = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        yield WindowSet([(r["id"], bytes(r["text"])) for r in mine.collect()], n), parts


def find_hits(docs: DataFrame, items: DataFrame, out: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW,
              max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents with column ``out``: number of words, ranges of hit words, and ids of the items found. Other columns stay."""
    docs = docs.withColumn(out, F.lit(None).cast(HITS))
    for windows, parts in slices(items, item_id, item_text, n, max_bytes):
        docs = docs.withColumn(out, _finder(docs.sparkSession.sparkContext.broadcast(windows), text_bytes(F.col(text)), F.col(out)))
        docs = cut_lineage(docs) if parts > 1 else docs
    return docs


def n_hit(found: Column) -> Column:
    """Number of hit words."""
    return F.aggregate(found["hits"], F.lit(0).cast("long"), lambda total, s: total + s["hi"] - s["lo"])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", drop_share: float = DROP_SHARE, gap: str = GAP, **options) -> DataFrame:
    """Documents with each hit span replaced by ``gap``; those with at least ``drop_share`` of their words hit are removed. Untouched
    documents keep their text byte by byte. Columns are those of ``docs``. The gap is a word, so what stands on both sides of a cut
    does not join to a new window."""
    found = fresh(docs, "found")
    filler = gap.encode()

    @F.arrow_udf("string")
    def trim(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        pairs = zip(texts, ranges.to_pylist())
        return pa.array([cut(raw.as_py(), [(s["lo"], s["hi"]) for s in spans], filler).decode("utf-8", "replace") if raw.is_valid else None for raw, spans in pairs], pa.string())

    marked = find_hits(docs, items, found, text, **options)
    hit = n_hit(F.col(found))
    kept = marked.where((hit == 0) | (hit < F.lit(drop_share) * F.col(f"{found}.n_words")))
    trimmed = trim.asNondeterministic()(F.when(hit > 0, text_bytes(F.col(text))), F.col(f"{found}.hits"))
    return kept.withColumn(text, F.coalesce(trimmed, F.col(text))).select(docs.columns)
