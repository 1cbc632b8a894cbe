"""Token counts by a map-side two-tier lookup.

A text is cut into pre-tokens by the byte-level pattern. The first tier is a compact table of the lengths of frequent
pre-tokens, broadcast once; the second is a bounded cache in every worker, filled by encoding what the table misses.
No pre-token is ever shuffled. Both tiers only save work: whatever they hold, the counts are the tokenizer's.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The documented bound of the sample that seeds the table, and of the table itself.
SEED_ROWS, TABLE_ENTRIES, CACHE_ENTRIES = 4_000, 50_000, 500_000
# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
#: Characters on whose kind two Unicode libraries may differ; texts with them go to the tokenizer whole.
_UNSURE = regex.compile(r"[\x1c-\x1f\x85᠎​﻿]|[^\u0000-￿]|\p{Cn}")
_state: dict = {}


class Counts(dict):
    """Pre-token to number of tokens; a miss is encoded and kept, and the cache starts anew when it is full."""

    def __init__(self, tokenizer, table: dict[str, int]):
        super().__init__(table)
        self.tokenizer, self.table = tokenizer, table

    def __missing__(self, piece: str) -> int:
        if len(self) >= len(self.table) + CACHE_ENTRIES:
            self.clear()
            self.update(self.table)
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:  # long pre-tokens are rare and would fill the cache
            self[piece] = n
        return n


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _splittable(path: str) -> list[str] | None:
    """The added tokens, if pre-tokens of this tokenizer are those of the pattern; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return [t["content"] for t in spec.get("added_tokens", [])] if plain else None


class TokenCounter:
    """Counts tokens of single texts; one per worker process and tokenizer."""

    def __init__(self, path: str, table: dict[str, int] | None = None):
        self.tokenizer = load_tokenizer(path)
        self.added = _splittable(path)
        self.counts = Counts(self.tokenizer, dict(table or {}))
        self.sure: set[str] = set()

    def _sure(self, text: str) -> bool:
        """Whether both Unicode libraries agree on the kind of every character; each character is looked at once."""
        new = set(text) - self.sure
        if not new:
            return True
        unsure = {c for c in new if _UNSURE.match(c)}
        self.sure |= new - unsure
        return not unsure

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None or any(t in text for t in self.added) or not self._sure(text):
            return self.whole(text)
        return sum(map(self.counts.__getitem__, _SPLIT.findall(text)))


def _counter(path: str, shared) -> TokenCounter:
    """One per worker process and tokenizer file, kept from task to task."""
    if path not in _state:
        _state.clear()
        _state[path] = TokenCounter(path, shared.value)
    return _state[path]


def frequent_lengths(df: DataFrame, path: str, text: str = "text", seed_rows: int = SEED_ROWS, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a bounded sample of rows, at most ``entries`` of them.

    A seed for a cache, not a statistic: counts of tokens don't depend on it. Every task counts its own sampled rows and
    sends its most frequent pre-tokens only, fewer the more tasks there are, so what the driver gets is bounded.
    """
    rows = df.count()
    if not rows:
        return {}
    parts = max(1, df.rdd.getNumPartitions())
    each = max(50, 4 * entries // parts)

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch[text].dropna():
                seen.update(p for p in _SPLIT.findall(value) if len(p) <= 32)
        yield pd.DataFrame(seen.most_common(each), columns=["piece", "n"]).astype({"n": "int64", "piece": "str"})

    sample = df.select(text).sample(min(1.0, seed_rows / rows), seed=11)
    found = sample.mapInPandas(top, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries)
    counter = TokenCounter(path)
    return {r[0]: counter.whole(r[0]) for r in found.collect()} if counter.added is not None else {}


def count_tokens(df: DataFrame, path: str, text: str = "text", table: dict[str, int] | None = None, out: str = "n_tokens") -> DataFrame:
    """Add ``n_tokens``, the tokens of the whole text without begin, end or other added ones.

    Strings of special tokens inside a text are handled as the library does by default: each is one token. Null and
    empty texts have 0 tokens; very long texts are counted whole. An existing column ``out`` is replaced. ``path`` is
    a tokenizer file that every executor has.
    """
    shared = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, path, text) if table is None else table)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path, shared)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    return df.select(*kept, run(F.col(f"`{text}`")).alias(out))
