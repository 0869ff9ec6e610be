"""Token counts by a two-tier lookup inside map tasks, without a shuffle of pre-tokens.

A text is cut into pre-tokens by the tokenizer's own pattern. The number of tokens of a frequent pre-token comes from a broadcast hash
table (at most ``table_size`` entries, so its size is bounded); the others are encoded once per worker and kept in a bounded cache.
The table only saves time: counts are exact whatever it holds.

The pattern is applied here by Python's own regular expressions, with letters and digits spelt out for the usual scripts. Texts with
any other character, and texts that hold an added token's string, are encoded whole by the tokenizer.

Defined cases: a null text counts as empty and has 0 bytes and 0 tokens; texts of any length are counted whole.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carnet.llm.common import text_bytes

LIMIT = 1024
#: Texts of the bounded sample from which the table of frequent pre-tokens is made; it decides speed, not results.
SAMPLE_TEXTS = 2_000
SAMPLE_CHARS = 4_000
TABLE_SIZE = 20_000
CACHE_SIZE = 400_000

RESULT = "struct<n_bytes: long, n_tokens: long>"
#: Letters and digits of the Latin blocks and of the Greek and Cyrillic alphabets.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-я"
DIGITS = "0-9²³¹¼-¾"
#: Beside them: tab, line ends, printable ASCII, Latin signs (no soft hyphen, no no-break space), common dashes, quotes, the euro sign.
SAFE = r"[\t\n\r\x20-\x7e¡-¬®-ɏΑ-ΡΣ-ωА-я‐-…€]*"
#: The tokenizer's published pattern (a fixed value) with these classes.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+"

_worker: dict = {}


class Counts:
    """Counts of one tokenizer file in one process: the tokenizer, the pattern, and the cache of encoded pre-tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.split = re.compile(PATTERN).findall
        self.safe = re.compile(SAFE).fullmatch
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def count(self, text: str, table: dict[str, int]) -> int:
        if any(a in text for a in self.added) or self.safe(text) is None:
            return self.whole(text)
        total, misses = 0, []
        for part, times in Counter(self.split(text)).items():
            length = table.get(part) or self.cache.get(part)
            if length is None:
                misses.append((part, times))
            else:
                total += length * times
        if misses:
            if len(self.cache) + len(misses) > CACHE_SIZE:
                self.cache.clear()
            for (part, times), length in zip(misses, self.lengths([p for p, _ in misses])):
                self.cache[part] = length
                total += length * times
        return total


def counter(path: str) -> Counts:
    """The process's counter for a tokenizer file, made once per worker."""
    if path not in _worker:
        _worker[path] = Counts(path)
    return _worker[path]


def frequent_table(docs: DataFrame, text: str, path: str, size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a bounded sample of texts (``SAMPLE_TEXTS`` texts, ``SAMPLE_CHARS`` characters each)."""
    own, seen = counter(path), Counter()
    for row in docs.select(F.substring(text, 1, SAMPLE_CHARS).alias("t")).limit(SAMPLE_TEXTS).collect():
        if row["t"] and own.safe(row["t"]):
            seen.update(own.split(row["t"]))
    parts = [p for p, _ in seen.most_common(size)]
    return dict(zip(parts, own.lengths(parts)))


def count_tokens(docs: DataFrame, path: str, out: str, text: str = "text") -> DataFrame:
    """The documents with column ``out``: bytes and tokens of the text. ``path`` is a tokenizer file every worker can read."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, text, path))

    @F.arrow_udf(RESULT)
    def count(texts: pa.Array) -> pa.Array:
        own, rows = counter(path), table.value
        raw = [t.as_py() for t in texts]
        return pa.StructArray.from_arrays([pa.array([len(b) for b in raw], pa.int64()), pa.array([own.count(b.decode("utf-8", "replace"), rows) if b else 0 for b in raw], pa.int64())], ["n_bytes", "n_tokens"])

    return docs.withColumn(out, count.asNondeterministic()(text_bytes(F.col(text))))
