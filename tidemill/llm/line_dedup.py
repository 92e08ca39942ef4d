"""Operator 7: line dedup by a log-template tree.

Each line falls through a tree of fixed depth: first by its token count, then by its ``DEPTH`` leading tokens, with
variable fields (tokens that hold one of 0-9, ``@`` or ``://``) replaced by a mark. In a leaf the line belongs to the
template of its tokens, and, so that fields which aren't recognisable by sight are generalised too, to templates that
leave some out. A line of ``LONG`` tokens or more is its leading tokens and ``PARTS`` stretches of the remaining ones;
one stretch is left out, or two (at least half of the line's tokens must be constant then), or the leading tokens (three
quarters must be constant then). Of a shorter line each token, the leading ones included, is left out in turn while
three quarters of the line stay constant; so lines under four tokens have to be equal but for fields known by sight. No
leaf is ever gathered: a template is a 64-bit sum of hashes of its token count and its constant tokens with their
places, so that leaving out a stretch subtracts its share, and the templates of all lines of a batch come from prefix
sums; they are counted with map-side combine.

A template recurs across documents if ``CONTEXTS`` documents that are pairwise unrelated hold it. Two documents are
related if the sketches of what they hold besides the template's lines (minimum hashes of the pairs of words in a line,
under ``SLOTS`` functions) agree in ``RELATED`` of the slots. However much of its documents a line makes up, they stay
unrelated; texts that hold nothing but the line are copies of one another and count as one document. Copies and near
copies, however many, count as one document: a group of them neither makes its own lines boilerplate, which is the
business of near-duplicate detection, nor hides lines that unrelated documents hold as well. The unrelated documents
are picked one after the other, by partition and then over all partitions; no more than ``CONTEXTS`` sketches of a
template are ever kept or sent on, so a hot line is no hot key.
All lines of a recurring template are dropped, in every document.

Three map passes over the texts: templates by distinct contents, sketches for the templates that enough contents hold,
and the cut. Both sets of templates are broadcast while they are at most ``BROADCAST_ROWS`` (8 bytes each); beyond that
sketches are made for all templates, and the lines' hashes meet the recurring ones in a shuffled join from which only
line numbers travel back, by the digest of the text (equal texts lose equal lines).

Defined results: null texts count as empty and have no lines; tokens are runs of bytes other than blank, tab and line
ends; blank lines are kept and not counted; line numbers count
from 0 over all lines split at line feeds. Repeated rows of an id are each treated, extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.memory import trimmed
from tidemill.llm.neardup import hashed_words
from tidemill.runtime import materialize

DEPTH = 3
PARTS = 4
LONG = 12
CONTEXTS = 5
SLOTS = 64
RELATED = 0.4
BROADCAST_ROWS = 2_000_000
HELD = 50_000
HELD_CHARS = 1 << 19

_FIELD = np.uint64(0x51ED270B9F1A2C4D)
_LEFT_OUT = [(0,), *((k,) for k in range(1, PARTS + 1)), *((j, k) for k in range(1, PARTS + 1) for j in range(1, k))]


def _term(h: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """The share of a token, or of a mark for what is left out, in its template's hash."""
    out = (h ^ (np.asarray(place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(32))


class Lines:
    """The lines of some texts, all at once: words, hashes and templates. Lines are numbered over all the texts."""

    def __init__(self, texts: list[str]):
        self.first = np.zeros(len(texts) + 1, dtype=np.int64)  # of each text's lines
        np.cumsum([t.count("\n") + 1 for t in texts], out=self.first[1:])
        hashes, fields, line, before = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)], 0
        source = "\n".join(texts).encode()
        data = np.frombuffer(source, dtype=np.uint8)
        ended = 0
        for at, h, starts, ends in hashed_words(source):
            before += np.count_nonzero(data[ended:at] == 10)
            ended = at
            part = data[at : at + int(ends[-1])]
            mark = ((part >= 48) & (part <= 57)) | (part == 64)
            mark[:-2] |= (part[:-2] == 58) & (part[1:-1] == 47) & (part[2:] == 47)
            seen = np.zeros(len(part) + 1, dtype=np.int32)
            np.cumsum(mark, out=seen[1:])
            newlines = np.cumsum(part == 10, dtype=np.int64)
            hashes.append(h)
            fields.append(seen[ends] > seen[starts])
            line.append(before + newlines[starts])
        self.hashes, self.fields, self.line = np.concatenate(hashes), np.concatenate(fields), np.concatenate(line)
        self.sizes = np.bincount(self.line, minlength=self.first[-1])
        self.start = np.cumsum(self.sizes) - self.sizes  # of each line's words

    def templates(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, lines): the templates that each line belongs to, in the order of the lines; none for a blank line."""
        place = np.arange(len(self.line)) - self.start[self.line]
        term = _term(np.where(self.fields, _FIELD, self.hashes), place)
        sums, held = np.zeros(len(term) + 1, dtype=np.uint64), np.zeros(len(term) + 1, dtype=np.int64)
        np.cumsum(term, out=sums[1:])
        np.cumsum(self.fields, out=held[1:])
        n, end = self.sizes, self.start + self.sizes
        fixed = n - (held[end] - held[self.start])
        whole = sums[end] - sums[self.start] + n.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        filled = np.flatnonzero(n)
        out, lines = [whole[filled]], [filled]
        # shorter lines: each token in turn, while so much stays constant
        open_line = (n < LONG) & (4 * (fixed - 1) >= 3 * n)
        token = np.flatnonzero(open_line[self.line] & ~self.fields)
        own = self.line[token]
        out.append(whole[own] - term[token] + _term(_FIELD, place[token] + 1000))
        lines.append(own)
        # longer ones: the leading tokens, a stretch, two stretches
        long = np.flatnonzero(n >= LONG)
        n, fixed, whole, begin = n[long], fixed[long], whole[long], self.start[long]
        cuts = [begin, *(begin + DEPTH + (n - DEPTH) * k // PARTS for k in range(PARTS + 1))]
        part = [sums[hi] - sums[lo] - _term(_FIELD, 2000 + k) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
        constant = [hi - lo - (held[hi] - held[lo]) for lo, hi in zip(cuts, cuts[1:])]
        for k in _LEFT_OUT:
            stays = fixed - sum(constant[i] for i in k)
            good = np.ones(len(long), bool) if len(k) == 1 and k[0] else 4 * stays >= 3 * n if len(k) == 1 else 2 * stays >= n
            out.append((whole - sum((part[i] for i in k[1:]), part[k[0]]))[good])
            lines.append(long[good])
        hashes, lines = np.concatenate(out), np.concatenate(lines)
        order = np.argsort(lines, kind="stable")
        return hashes[order], lines[order]

    def text_of(self, lines: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, lines, side="right") - 1


def templates(line: str) -> list[int]:
    """Hashes of the templates that a line belongs to; none for a blank line."""
    return Lines([line]).templates()[0].tolist()


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``HELD_CHARS`` in sum."""
    lo = chars = 0
    for i, text in enumerate(texts):
        chars += len(text) + 1
        if chars >= HELD_CHARS:
            yield lo, i + 1
            lo, chars = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _line_minima(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of ``SLOTS`` minimum hashes for each line (of so many of the words hashed to ``h``), over its pairs of words
    (a single word by itself); all ones for a blank line."""
    out = np.full((len(sizes), SLOTS), 0xFFFFFFFF, dtype=np.uint32)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    last = np.cumsum(sizes)[filled] - 1
    features = np.empty_like(h)
    features[:-1] = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    features[last] = features[np.maximum(last - 1, 0)]  # a line's last word has no pair of its own
    single = last[sizes[filled] == 1]
    features[single] = h[single]
    starts = last + 1 - sizes[filled]
    step = max(1, (1 << 18) // len(h))
    for lo in range(0, SLOTS, step):
        values = (features[None, :] * _FACTORS[lo : lo + step, None]) >> np.uint64(32)
        out[filled, lo : lo + step] = np.minimum.reduceat(values, starts, axis=1).T
    return out


class _Rest:
    """Sketches of a document without some of its lines."""

    def __init__(self, lines: Lines, text: int):
        own = slice(lines.first[text], lines.first[text + 1])
        sizes = lines.sizes[own]
        begin = lines.start[own.start]
        self.minima = _line_minima(lines.hashes[begin : begin + int(sizes.sum())], sizes)
        none = np.full((1, SLOTS), 0xFFFFFFFF, dtype=np.uint32)
        self.before = np.minimum.accumulate(np.concatenate([none, self.minima]))
        self.after = np.minimum.accumulate(np.concatenate([none, self.minima[::-1]]))[::-1]

    def without(self, places: list[int]) -> np.ndarray:
        if len(places) == 1:
            return np.minimum(self.before[places[0]], self.after[places[0] + 1])
        return np.delete(self.minima, places, axis=0).min(axis=0, initial=0xFFFFFFFF)


class _Picked:
    """Sketches of up to ``most`` pairwise unrelated documents for each template."""

    def __init__(self, most: int):
        self.most, self.kept, self.n = most, {}, 0

    def full(self, template: int) -> bool:
        return len(self.kept.get(template, ())) >= self.most

    def add(self, template: int, sketch: np.ndarray) -> None:
        have = self.kept.setdefault(template, [])
        if len(have) < self.most and all(np.count_nonzero(sketch == other) < RELATED * SLOTS for other in have):
            have.append(sketch)
            self.n += 1

    def batch(self) -> pa.RecordBatch:
        found = [t for t, have in self.kept.items() for _ in have]
        sketches = [s.tobytes() for have in self.kept.values() for s in have]
        return pa.RecordBatch.from_arrays([_signed(found), pa.array(sketches, pa.binary())], names=["template", "sketch"])


def _signed(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _new_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int]]]:
    """The texts of a partition and hashes of their contents, about ``HELD_CHARS`` at once; copies of a text are left
    out while it is remembered (a million texts at least)."""
    seen: set[int] = set()
    for batch in batches:
        texts, contents = [], []
        for value in batch.column(0):
            source = value.as_py() or ""
            content = xxhash.xxh3_64_intdigest(source)
            if content not in seen:
                seen.add(content)
                texts.append(source)
                contents.append(content)
        for lo, hi in _slices(texts):
            yield texts[lo:hi], contents[lo:hi]
        if len(seen) > 1_000_000:
            seen.clear()


def _contents(df: DataFrame, text: str, contexts: int) -> DataFrame:
    """(template): the hashes of the templates that at least ``contexts`` different texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, contents in _new_texts(batches):
            lines = Lines(texts)
            found, at = lines.templates()
            around = np.array(contents, dtype=np.uint64)[lines.text_of(at)]
            order = np.lexsort((found, around))
            found, around = found[order], around[order]
            fresh = np.ones(len(found), dtype=bool)
            fresh[1:] = (found[1:] != found[:-1]) | (around[1:] != around[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[fresh].view(np.int64)) for x in (found, around)], names=["template", "content"])

    rows = df.select(F.col(text).cast("string")).mapInArrow(trimmed(run), "template long, content long").distinct()
    return rows.groupBy("template").agg(F.count(F.lit(1)).alias("contents")).filter(F.col("contents") >= contexts).select("template")


def _sketches(df: DataFrame, text: str, contexts: int, known) -> DataFrame:
    """(template, sketch): for each partition, up to ``contexts`` unrelated documents of each template (of those in the
    broadcast ``known``, or of all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if known is None else _Sorted(known.value)
        picked = _Picked(contexts)
        for texts, _ in _new_texts(batches):
            lines = Lines(texts)
            found, at = lines.templates()
            if wanted is not None:
                held = wanted.held(found)
                found, at = found[held], at[held]
            text_of = lines.text_of(at)
            edges = np.searchsorted(text_of, np.arange(len(texts) + 1))
            for i in range(len(texts)):
                places: dict[int, list[int]] = {}
                for t, line in zip(found[edges[i] : edges[i + 1]].tolist(), (at[edges[i] : edges[i + 1]] - lines.first[i]).tolist(), strict=True):
                    if not picked.full(t):
                        places.setdefault(t, []).append(line)
                if places:
                    rest = _Rest(lines, i)
                    for t, own in places.items():
                        picked.add(t, rest.without(own))
            if picked.n > HELD:
                yield picked.batch()
                picked = _Picked(contexts)
        yield picked.batch()

    return df.select(F.col(text).cast("string")).mapInArrow(trimmed(run), "template long, sketch binary")


def recurring(df: DataFrame, text: str = "text", contexts: int = CONTEXTS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(template): the hashes of the templates that recur across documents."""
    held = materialize(_contents(df, text, contexts), "held")
    known = _shared(held) if held.count() <= broadcast_rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked, last = _Picked(contexts), None
        for batch in batches:
            out = []
            for t, sketch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t != last:
                    picked, last = _Picked(contexts), t
                if not picked.full(t):
                    picked.add(t, np.frombuffer(sketch, dtype=np.uint32))
                    if picked.full(t):
                        out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["template"])

    rows = _sketches(df, text, contexts, known).repartition("template").sortWithinPartitions("template", "sketch")
    return rows.mapInArrow(trimmed(run), "template long")


def _shared(found: DataFrame):
    """The template hashes as a sorted broadcast array."""
    column = found.toArrow().column(0).to_numpy()
    return found.sparkSession.sparkContext.broadcast(np.sort(column.astype(np.int64).view(np.uint64)))


def _strip(lines: list[str], gone: list[int]) -> str:
    out = set(gone)
    return "\n".join([line for i, line in enumerate(lines) if i not in out])


def drop_lines(
    df: DataFrame, text: str = "text", found: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``df`` with the recurring lines taken out of ``text``, and ``n_lines`` and ``dropped`` (line numbers)."""
    found = materialize(recurring(df, text, broadcast_rows=broadcast_rows) if found is None else found, "recurring")
    made = ("n_lines", "dropped")
    kept = [c for c in df.columns if c not in made]
    at = kept.index(text)
    schema = T.StructType([df.schema[c] for c in kept])
    schema = schema.add("n_lines", T.LongType()).add("dropped", T.ArrayType(T.IntegerType()))

    def rebuilt(batch: pa.RecordBatch, texts: list[str], filled: list[int], gone: list[list[int]]) -> pa.RecordBatch:
        columns = list(batch.columns[: len(kept)])
        columns[at] = pa.array([_strip(t.split("\n"), g) if g else t for t, g in zip(texts, gone, strict=True)], pa.string())
        columns += [pa.array(filled, pa.int64()), pa.array(gone, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], Lines]]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for lo, hi in _slices(texts):
                yield batch.slice(lo, hi - lo), texts[lo:hi], Lines(texts[lo:hi])

    def filled(lines: Lines) -> list[int]:
        return np.add.reduceat(lines.sizes > 0, lines.first[:-1], dtype=np.int64).tolist()

    if found.count() <= broadcast_rows:
        shared = _shared(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _Sorted(shared.value)
            for part, texts, lines in parts(batches):
                hashes, own = lines.templates()
                hit = np.unique(own[known.held(hashes)])
                edges = np.searchsorted(hit, lines.first)
                gone = [(hit[lo:hi] - first).tolist() for lo, hi, first in zip(edges, edges[1:], lines.first)]
                yield rebuilt(part, texts, filled(lines), gone)

        return df.select(*kept).mapInArrow(trimmed(run), schema)

    keyed = df.select(*kept).withColumn("__text", F.sha2(F.col(text).cast("binary"), 256))  # equal texts lose equal lines

    def templates_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, lines in parts(batches):
            hashes, own = lines.templates()
            row = lines.text_of(own)
            columns = [part.column(0).take(pa.array(row)), pa.array((own - lines.first[row]).astype(np.int32)), _signed(hashes)]
            yield pa.RecordBatch.from_arrays(columns, names=["__text", "line", "template"])

    hit = keyed.select("__text", text).mapInArrow(trimmed(templates_of), "__text string, line int, template long").join(found, "template")
    hit = hit.select("__text", "line").distinct().groupBy("__text").agg(F.array_sort(F.collect_list("line")).alias("__gone"))
    joined = keyed.join(hit, "__text", "left").select(*kept, "__gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, lines in parts(batches):
            yield rebuilt(part, texts, filled(lines), [g or [] for g in part.column(len(kept)).to_pylist()])

    return joined.mapInArrow(trimmed(cut), schema)


class _Sorted:
    """Membership in a sorted array."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def held(self, wanted: np.ndarray) -> np.ndarray:
        if not len(wanted) or not len(self.values):
            return np.zeros(len(wanted), dtype=bool)
        at = np.searchsorted(self.values, wanted)
        return self.values[np.minimum(at, len(self.values) - 1)] == wanted


def listing(df: DataFrame) -> DataFrame:
    """The columns of the query: per document the number of lines, those dropped, and a digest of what stays."""
    out = drop_lines(df.select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_lines",
        F.size("dropped").cast("long").alias("n_dropped"),
        F.concat_ws(",", F.col("dropped").cast("array<string>")).alias("dropped_lines"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


def strip_recurring(df: DataFrame) -> DataFrame:
    """The filtering form: ``df`` with recurring lines taken out; documents with nothing else in them go."""
    out = drop_lines(df)
    out = out.filter((F.size("dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns)
