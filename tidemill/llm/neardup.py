"""Operator 4: near-duplicate documents by min-max hashing.

A document's set holds its distinct shingles of five words (words: runs without blanks, tabs or line ends, A-Z in lower
case; a shorter text is one shingle; a text without words has an empty set and is linked with nothing). Documents are
linked where the Jaccard similarity of their sets is at least 0.75, and a component is what links connect.

1. One map pass makes each document's row: set size, a 128-bit fingerprint of the set, the keys of its bands and a
   sketch. Min-max hashing keeps the minimum and the maximum of the set under each of ``PERMUTATIONS`` hash functions,
   two signature values for one evaluation, and both uses below are made of these values only. ``BANDS`` bands of
   ``ROWS`` values miss a pair at similarity 0.75 with probability (1 - 0.75^3)^42 < 2e-10.
2. Equal sets form one class (a group-by with map-side combine); only its smallest id goes on, so that a group of
   copies of any size is one row from here on.
3. Band keys held by two classes or more give buckets. Star rounds: in each bucket that still spans several components
   the members are compared with one hub of the bucket, confirmed links are merged, and the next round takes another
   hub. A bucket whose members are all connected drops out, so pairs inside a group are never listed.
4. What then still shares a bucket across components is checked completely. Buckets of up to ``SMALL`` members are
   joined pair by pair, with the set sizes and the sketches (three bits of each signature value) in the join condition:
   a pair is let through while at most ``SKETCH_MAX`` of the values' bits differ, which a pair at similarity 0.75
   exceeds with probability under ``SKETCH_MISS``; with the bands, a link is missed with probability under 3e-10.
   Larger buckets (of those with the same members only one) are dealt into blocks of bounded size; each pair of
   blocks is one task, which multiplies the sets' incidence matrices and hands on only links that join components.
   No cap, no sampling: every pair that shares a bucket is either connected already or compared.
5. Every link is confirmed on the full sets of both texts. Only texts of documents that share a bucket are kept for
   this, and of these only those in question are read and shuffled in a round.
6. Components come from rounds of minimum labels over the confirmed links, as joins and group-bys; nothing but counts
   reaches the driver, and each round is written to the shared folder.

Defined results: repeated rows of a document id are one document (with different texts under one id, of the largest
size and the smallest component); null texts count as empty; ties need no
rule, the smallest id of a component names it.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.memory import trimmed
from tidemill.runtime import discard, materialize

WORDS = 5
PERCENT = 75
PERMUTATIONS = 63
ROWS = 3
BANDS = 2 * PERMUTATIONS // ROWS
SKETCH_BITS = 3
SKETCH_MISS = 1e-10
STAR_ROUNDS = 6
STAR_YIELD = 5
SMALL = 16
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 300_000

SKETCH = [f"s{i}" for i in range(6)]  # 21 codes of three bits each
_SCHEMA = f"doc_id long, n_shingles long, fingerprint binary, bands array<long>, {', '.join(f'{s} long' for s in SKETCH)}"


def _sketch_max() -> int:
    """The least number of differing codes that a pair at similarity 0.75 exceeds with probability under ``SKETCH_MISS``."""
    n, p, tail = 2 * PERMUTATIONS, (1 - PERCENT / 100) * (1 - 2.0**-SKETCH_BITS), 0.0
    for k in range(n, 0, -1):
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail >= SKETCH_MISS:
            return k
    return 0


SKETCH_MAX = _sketch_max()


_BASE = 0x9E6C63D0876A9A47 | 1
BLOCK_BYTES = 1 << 20
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """At least the first ``n`` powers of the base and of its inverse, modulo 2^64; grown as needed, kept by the worker."""
    if not _tables or len(_tables[0]) < n:
        _tables.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            values = np.full(1 << max(16, n.bit_length()), base, dtype=np.uint64)
            values[0] = 1
            _tables.append(np.cumprod(values, dtype=np.uint64))
    return _tables


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def hashed_words(source: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset of the block, hashes, starts, ends) of the words, block by block; starts and ends count from the offset.

    A word's hash is a polynomial over its bytes, out of prefix sums over the block. Blocks end at blanks, so what is
    held besides the words follows the block (or the longest word), not the text."""
    data = np.frombuffer(source, dtype=np.uint8)
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        if end < len(data):
            found = np.flatnonzero(_blank(data[at:end]))
            reach = end
            while not len(found) and reach < len(data):  # a word longer than a block
                found = np.flatnonzero(_blank(data[reach : reach + BLOCK_BYTES])) + (reach - at)
                found = found[:1]
                reach += BLOCK_BYTES
            end = at + int(found[-1]) + 1 if len(found) else len(data)
        part = data[at:end]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], _blank(part), [True]))))
        starts, ends = edges[0::2], edges[1::2]
        if len(starts):
            power, inverse = _powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * inverse[starts]
            h ^= (ends - starts).astype(np.uint64) << np.uint64(56)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            yield at, h, starts, ends
        at = end


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order, A-Z in lower case."""
    found = [h for _, h, _, _ in hashed_words((text or "").encode().lower())]  # bytes: lower() knows ASCII only
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), dtype=np.uint64)
    for k in range(min(size, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out)


@lru_cache(maxsize=1)
def _hash_functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    n = PERMUTATIONS
    return draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(items: np.ndarray) -> tuple[list[int], list[int]]:
    """(keys of the bands, words of the sketch) of a set that isn't empty."""
    a, b = _hash_functions()
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(len(a), dtype=np.uint64)
    for at in range(0, len(items), 256):  # a block stays in the cache
        part = items[at : at + 256]
        part = part ^ (part >> np.uint64(33))
        block = a[:, None] * part[None, :] + b[:, None]
        block ^= block >> np.uint64(32)
        np.minimum(low, block.min(axis=1), out=low)
        np.maximum(high, block.max(axis=1), out=high)
    both = np.concatenate([low, high])
    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for row in both.reshape(ROWS, BANDS):
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    codes = (both * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SKETCH_BITS)
    places = np.arange(len(codes) // len(SKETCH), dtype=np.uint64) * np.uint64(SKETCH_BITS)
    words = (codes.reshape(len(SKETCH), -1) << places).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64), words.view(np.int64).tolist()


def signatures(df: DataFrame) -> DataFrame:
    """The row of each document of (doc_id, text); see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, marks, bands, sketch = [], [], [], []
                for text in part.column(1):
                    items = shingles(text.as_py())
                    sizes.append(len(items))
                    if len(items):
                        keys, words = signature(items)
                        marks.append(xxhash.xxh3_128_digest(items.tobytes()))
                        bands.append(keys)
                        sketch.append(words)
                    else:
                        marks.append(None)
                        bands.append(None)
                        sketch.append([None] * len(SKETCH))
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                columns += [pa.array([s[i] for s in sketch], pa.int64()) for i in range(len(SKETCH))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "fingerprint", "bands", *SKETCH])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), _SCHEMA)


def linked(left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union."""
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= percent * (len(left) + len(right) - both)


def confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' full sets are linked. Only the texts of these pairs are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()  # hubs come again and again

        def get(doc: int, text: pa.Scalar) -> np.ndarray:
            found = recent.get(doc)
            if found is None:
                found = recent[doc] = shingles(text.as_py())
                if len(recent) > 64:
                    recent.popitem(last=False)
            return found

        for batch in batches:
            a, b, ta, tb = batch.columns
            keep = [linked(get(x, ta[i]), get(y, tb[i])) for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True))]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(needed, "doc_id", "left_semi")
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(run), "a long, b long")


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, component) of the nodes in ``links`` (a, b): the smallest node each can reach.

    Alternating rounds connect every node's larger neighbours to its smallest one, then its smaller ones, until the
    links are stars. A node's neighbours are only ever combined to their minimum, never gathered.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), label)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.u", "e.v").filter("u != v").distinct(), label)
        # stars: as many links as nodes with a smaller neighbour, and no centre that has one itself
        done = after.select("u").intersect(after.select("v")).isEmpty() and after.count() == after.select("u").distinct().count()
        discard(edges)
        edges = after
        if done:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def near_duplicates(df: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document of ``df`` (doc_id, text)."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(signatures(docs), "signatures")
    classes = rows.filter("n_shingles > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    reps = rows.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    narrow = reps.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), *SKETCH)
    keyed = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    members = materialize(keyed.join(shared, "key"), "members")
    docs = docs.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    docs = materialize(docs.dropDuplicates(["doc_id"]), "texts")

    links, labels, turn = None, None, 0
    while True:
        if labels is None:
            open_rows = members.withColumn("component", F.col("node"))
        else:
            joined = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            span = joined.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
            open_rows = materialize(joined.join(span.filter("lo < hi").select("key"), "key"), "open")
        last = turn < 0
        if last:
            rows_n = materialize(open_rows.join(narrow, "node"), "open")
            sizes = rows_n.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
            sized = rows_n.join(sizes, "key")
            pairs = materialize(_open_pairs(sized.filter(F.col("members") <= SMALL)), "pairs")
            in_blocks = materialize(_block_links(sized.filter(F.col("members") > SMALL), docs), "found")
            found = materialize(confirm(pairs, docs).unionByName(in_blocks), "found")
        else:
            pairs = materialize(_likely(_star_pairs(open_rows, turn), narrow), "pairs")
            found = materialize(confirm(pairs, docs), "found")
        confirmed = found.count()
        if confirmed:
            links = found if links is None else links.unionByName(found)
            labels = materialize(components(links), "labels")
        if last:
            break
        # stars go on while they merge much; the rest is settled pair by pair
        turn = turn + 1 if turn + 1 < STAR_ROUNDS and confirmed * STAR_YIELD >= pairs.count() else -1
        discard(pairs)
    discard(docs)
    named = rows.select("doc_id", "n_shingles", "fingerprint").join(classes, "fingerprint", "left")
    if labels is not None:
        named = named.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
        component = F.coalesce("component", "rep", "doc_id")
    else:
        component = F.coalesce("rep", "doc_id")
    return named.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min(component).alias("component_id"))  # repeated ids once


def _alike(a: str, b: str) -> F.Column:
    """Sets of these sizes and sketches can be linked."""
    sizes = (100 * F.col(f"{a}.n") >= PERCENT * F.col(f"{b}.n")) & (100 * F.col(f"{b}.n") >= PERCENT * F.col(f"{a}.n"))
    ones = F.lit(sum(1 << (SKETCH_BITS * i) for i in range(2 * PERMUTATIONS // len(SKETCH))))

    def differing(word: str) -> F.Column:
        x = F.col(f"{a}.{word}").bitwiseXOR(F.col(f"{b}.{word}"))
        for step in range(1, SKETCH_BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(F.col(f"{a}.{word}").bitwiseXOR(F.col(f"{b}.{word}")), step))
        return F.bit_count(x.bitwiseAND(ones))

    return sizes & (sum(map(differing, SKETCH), F.lit(0)) <= SKETCH_MAX)


def _star_pairs(open_rows: DataFrame, turn: int) -> DataFrame:
    """In each bucket, every member of another component with the hub of this turn (first the smallest id)."""
    order = F.col("node") if turn == 0 else F.xxhash64(F.col("component"), F.lit(turn))
    hubs = open_rows.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "component")).alias("hub"))
    pairs = open_rows.join(hubs, "key").filter("component != hub.component").select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _likely(pairs: DataFrame, narrow: DataFrame) -> DataFrame:
    left, right = narrow.alias("l"), narrow.alias("r")
    joined = pairs.join(left, F.col("a") == F.col("l.node")).join(right, F.col("b") == F.col("r.node"))
    return joined.filter(_alike("l", "r")).select("a", "b")


def _open_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different components in buckets of at most ``SMALL`` members: under ``SMALL`` pairs for each row."""
    left, right = rows.alias("l"), rows.alias("r")
    on = (F.col("l.key") == F.col("r.key")) & (F.col("l.component") < F.col("r.component")) & _alike("l", "r")
    return left.join(right, on).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def _block_links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that connect components inside larger buckets, without listing pairs.

    A bucket's members are dealt into blocks of bounded size; each pair of blocks is one task that multiplies the
    incidence matrices of the full sets and hands on only links that join components not yet joined in it.
    """
    own_set = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    sets = rows.groupBy("key", "members", "total").agg(*own_set).groupBy("members", "total", "x0", "x1").agg(F.min("key").alias("key"))
    rows = rows.join(sets.select("key"), "key", "left_semi")  # of buckets with the same members one
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_MEMBERS, F.col("total") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
    dealt = rows.select("key", "node", "component", blocks.alias("blocks")).withColumn("own", own)
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = dealt.select("key", "node", "component", F.explode(cells).alias("cell"))
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    member = F.struct("node", "component", "text")
    groups = dealt.join(texts, "node").groupBy("key", "cell").agg(F.collect_list(member).alias("members")).select("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                members = cell.values
                sets = [shingles(t.as_py()) for t in members.field("text")]
                links = joining_links(sets, members.field("node").to_pylist(), members.field("component").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return groups.mapInArrow(trimmed(run), "a long, b long")


def joining_links(sets: list[np.ndarray], nodes: list[int], component: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links between different components, out of all pairs of the sets."""
    size = np.array([len(x) for x in sets], dtype=np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], column[code[keep]]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = 2048
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        part = slice(*np.searchsorted(code, [lo, lo + width]))
        dense = np.zeros((len(sets), width), dtype=np.float32)
        dense[owner[part], code[part] - lo] = 1
        both += dense @ dense.T
    close = 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)
    known = np.array(component)
    close &= known[:, None] != known[None, :]
    parent = {c: c for c in component}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(np.triu(close)), strict=True):
        a, b = root(component[i]), root(component[j])
        if a != b:
            parent[a] = b
            out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return out


def groups(df: DataFrame) -> DataFrame:
    """The contract columns of the query."""
    return near_duplicates(df).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(df: DataFrame) -> DataFrame:
    """The filtering form: the documents of ``df`` that name their component (the smallest id of each)."""
    kept = near_duplicates(df).filter("doc_id = component_id").select("doc_id")
    return df.join(kept, "doc_id", "left_semi").select(*df.columns)
