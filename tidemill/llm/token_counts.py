"""Operator 9: token counts by a map-side two-tier lookup.

Tier one is a compact table of the corpus's most frequent pre-tokens with their token counts, broadcast to every
worker. It comes from one pass over all texts in which each partition keeps a bounded summary of its pre-tokens (at
most ``SUMMARY`` counters, the rarest dropped when full) and hands on its ``HANDED_ON`` best; only these summaries are
added up, no pre-token is ever shuffled. What makes up more than 1 / ``BOUND`` of the corpus enters the table, which can
thus never hold ``BOUND`` entries. Tier two is the worker's own bounded cache: a pre-token that the table lacks
is encoded once by the tokenizer library and remembered. The table only makes things fast: counts are exact whatever
it holds.

Null texts count as empty: 0 bytes, 0 tokens. Strings of special tokens inside a text are one token each, as the
library's default has it. Extra columns pass through; columns that clash with output names are replaced.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.bpe import vocabulary_path
from tidemill.runtime import materialize

VOCAB = "byte_bpe_50k.json"
BOUND = 100_000
HANDED_ON = 16384
SUMMARY = 150_000
CACHE = 400_000
MAX_KEY = 64
MAX_TOKENS = 512


class Counter2(dict):
    """Pre-token to token count; what is missing is encoded and cached, and the cache has a bound."""

    def __init__(self, tool: PreTokens, table: dict[str, int]):
        super().__init__(table)
        self.tool, self.table = tool, table

    def __missing__(self, piece: str) -> int:
        n = self.tool.length(piece)
        if len(piece) <= MAX_KEY:
            if len(self) >= CACHE + len(self.table):
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n


class PreTokens:
    """The pre-tokens of a text and their lengths in tokens, for a byte-level tokenizer file."""

    def __init__(self, vocab: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(vocabulary_path(vocab))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self.names = sorted(special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.names)))

    def length(self, piece: str) -> int:
        return len(self._library.encode(piece, add_special_tokens=False).ids)

    def parts(self, text: str) -> tuple[list[str], int]:
        """The stretches between special strings, and how many of these there are."""
        if not any(name in text for name in self.names):
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1


@lru_cache(maxsize=2)
def pre_tokens(vocab: str) -> PreTokens:
    return PreTokens(vocab)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    for value in batch.column(column):
        yield value.as_py() or ""


def frequent_lengths(df: DataFrame, text: str = "text", vocab: str = VOCAB, bound: int = BOUND) -> dict[str, int]:
    """The table of tier one: the pre-tokens that make up more than 1 / ``bound`` of all texts, with their token counts."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, seen = pre_tokens(vocab), Counter()
        for batch in batches:
            for value in _texts(batch, 0):
                for part in tool.parts(value)[0]:
                    seen.update(tool.pattern.findall(part))
                if len(seen) > 2 * SUMMARY:
                    seen = Counter(dict(seen.most_common(SUMMARY)))
        best = [(p, n) for p, n in seen.most_common(HANDED_ON) if n > 1 and len(p) <= MAX_KEY]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["piece", "n"]
        )

    summed = df.select(F.col(text).cast("string")).mapInArrow(summaries, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    summed = materialize(summed, "pieces")
    total = summed.agg(F.sum("n")).head()[0] or 0
    found = summed.filter(F.col("n") * bound > total).collect()  # fewer than ``bound`` pieces hold more than 1 / bound
    tool = pre_tokens(vocab)
    return {row.piece: tool.length(row.piece) for row in found}


def count_tokens(
    df: DataFrame, text: str = "text", vocab: str = VOCAB, bound: int = BOUND, max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """``df`` without its text, with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``max_tokens``)."""
    made = ("n_tokens", "n_bytes", "over_limit")
    kept = [c for c in df.columns if c not in (*made, text)]
    shared = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, text, vocab, bound))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("n_tokens", T.LongType())])
    schema = schema.add("n_bytes", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pre_tokens(vocab)
        lookup = Counter2(tool, shared.value).__getitem__
        for batch in batches:
            lengths = []
            for value in _texts(batch, len(kept)):
                parts, n = tool.parts(value)
                lengths.append(n + sum(sum(map(lookup, tool.pattern.findall(p))) for p in parts))
            columns = [batch.column(i) for i in range(len(kept))]
            size = batch.column(len(kept) + 1)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lengths, pa.int64()), size], names=[*kept, "n_tokens", "n_bytes"])

    value = F.col(text).cast("string")
    source = df.select(*kept, value.alias(text), F.coalesce(F.octet_length(value), F.lit(0)).cast("long").alias("n_bytes"))
    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > max_tokens)


def lengths(df: DataFrame) -> DataFrame:
    """The contract columns of the query."""
    return count_tokens(df.select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
