"""Operator 1: byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut into halves until a half is at most ``leaf_chars`` long. A leaf becomes a *segment*: the token ids of
the part whose tokens can no longer change, and the still open text before and after that part. Two neighbouring
segments join by encoding only the window between their settled parts; where a side has no settled part, the window
grows over all of it. Joining is associative, so any tree over the leaves gives the same ids.

Why the outside of a window is settled. A *sync point* is a place where a character that is not white space is
followed by a blank or a line feed. No alternative of the split pattern holds white space behind another character,
so every match ends or begins there, whatever surrounds it; and a match looks at most one character past its end.

Inside one match of the pattern (white-space-free runs can be very long) the same reduction works on bytes: halves
are encoded, and neighbours join by re-encoding a window of tokens at the seam that doubles until its outer tokens
form pairs that encode to themselves with the tokens outside. A token sequence all of whose neighbouring pairs encode
to themselves is the encoding of its bytes, so the tokens outside can no longer change.

Null texts count as empty, empty texts have no tokens. Ties between merges go to the leftmost pair, as in the public
library. Extra columns are passed through untouched; a column that clashes with an output name is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.memory import trimmed

VOCAB = "byte_bpe_50k.tiktoken"
LEAF_CHARS = 2048
BATCH_CHARS = 1 << 20

_FIRST_SYNC = re.compile(r"(?<=\S)[ \n]")


class Codec:
    """Encodes and decodes by the ranks of a vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS):
        import regex
        import tiktoken

        self._library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._pattern = regex.compile(pattern)
        self.leaf = max(1, leaf_chars)
        self.vocab: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self._whole_pairs: dict[tuple[int, int], bool] = {}

    # --- encoding ------------------------------------------------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        """Ids of the whole text."""
        if not text:
            return []
        if len(text) <= self.leaf:
            return self._library.encode_ordinary(text)
        first, ids, last = self._segment(text, 0, len(text))
        if first is None:  # no sync point at all
            return self._window(text)
        return self._window(text[:first]) + ids + self._window(text[last:])

    def _segment(self, text: str, lo: int, hi: int) -> tuple[int | None, list[int], int]:
        """(first sync point, ids from there to the last one, last sync point) of text[lo:hi]; None without any."""
        if hi - lo > self.leaf:
            mid = (lo + hi) // 2
            return self._join(text, self._segment(text, lo, mid), self._segment(text, mid, hi))
        found = _FIRST_SYNC.search(text, lo, hi)
        if not found:
            return None, [], hi
        first = last = found.start()
        for last_match in _FIRST_SYNC.finditer(text, max(first, hi - 64), hi):
            last = last_match.start()
        return first, self._library.encode_ordinary(text[first:last]), last

    def _join(self, text: str, left: tuple, right: tuple) -> tuple[int | None, list[int], int]:
        if left[0] is None:
            return right
        if right[0] is None:
            return left
        ids = left[1]
        ids.extend(self._window(text[left[2] : right[0]]))
        ids.extend(right[1])
        return left[0], ids, right[2]

    def _window(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self._library.encode_ordinary(text)
        out: list[int] = []
        for match in self._pattern.finditer(text):
            out.extend(self.encode_piece(match.group().encode()))
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern, however long."""
        if len(piece) <= self.leaf:
            return self._library._encode_single_piece(piece)
        mid = len(piece) // 2
        return self._join_tokens(self.encode_piece(piece[:mid]), self.encode_piece(piece[mid:]))

    def _stable(self, a: int, b: int) -> bool:
        found = self._whole_pairs.get((a, b))
        if found is None:
            if len(self._whole_pairs) > 500_000:
                self._whole_pairs.clear()
            found = self._library._encode_single_piece(self.vocab[a] + self.vocab[b]) == [a, b]
            self._whole_pairs[a, b] = found
        return found

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if self._stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            seam = b"".join([self.vocab[t] for t in left[len(left) - i :] + right[:j]])
            window = self._library._encode_single_piece(seam)
            left_ok = i >= len(left) or self._stable(left[len(left) - i - 1], window[0])
            right_ok = j >= len(right) or self._stable(window[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + window + right[j:]
            if not left_ok:
                i = min(len(left), 2 * i)
            if not right_ok:
                j = min(len(right), 2 * j)

    # --- decoding ------------------------------------------------------------------------------------------------
    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: leaves concatenate their tokens, neighbours concatenate up the tree."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.vocab.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers of the worker."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def codec(vocab: str = VOCAB, leaf_chars: int = LEAF_CHARS) -> Codec:
    """The codec of this process (driver or Python worker)."""
    import public_tokenizers

    with open(vocabulary_path(vocab), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return Codec(ranks, public_tokenizers.PATTERN, leaf_chars)


def _slices(sizes: Iterable[int], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` in sum, so that what a worker holds doesn't follow the batch size."""
    begin = total = end = 0
    for end, size in enumerate(sizes, 1):
        total += size
        if total >= limit:
            yield begin, end
            begin, total = end, 0
    if begin < end:
        yield begin, end


def _list_array(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([np.asarray(r, dtype=np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))


def round_trip(
    df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", vocab: str = VOCAB
) -> DataFrame:
    """``df`` with the token ids of each text and the bytes that these ids decode to. One map pass, no shuffle."""
    kept = [c for c in df.columns if c not in (ids, decoded, text)]
    schema = T.StructType(
        [df.schema[c] for c in kept]
        + [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocab)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = [len(x) if (x := t.as_py()) else 1 for t in texts]
            for lo, hi in _slices(sizes):
                rows = [tool.encode(t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
                back = pa.array([tool.decode(r) for r in rows], type=pa.binary())
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, _list_array(rows), back], names=[*kept, ids, decoded])

    return df.select(*kept, F.col(text).cast("string")).mapInArrow(trimmed(run), schema)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocab: str = VOCAB) -> DataFrame:
    """``df`` with the token ids of each text in ``ids``; the text column goes."""
    return round_trip(df, text, ids, "__decoded", vocab).drop("__decoded")


def decode(df: DataFrame, ids: str = "ids", text: str = "text", vocab: str = VOCAB) -> DataFrame:
    """``df`` with the bytes of each row's ids (null: empty) in ``text``; the ids go."""
    kept = [c for c in df.columns if c not in (ids, text)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(text, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(vocab)
        for batch in batches:
            back = [tool.decode(r or []) for r in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(back, type=pa.binary())], names=[*kept, text])

    return df.select(*kept, F.col(ids).cast("array<int>")).mapInArrow(trimmed(run), schema)


def digests(df: DataFrame) -> DataFrame:
    """The contract columns of the query: counts and digests of ids and decoded bytes."""
    out = round_trip(df.select("doc_id", "text"))
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
