"""Operator 3: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut, from left to right, into the longest
phrases that occur in that labelled text; the number of phrases times log2 of the labelled length is the cross-parsing
estimate of the bits the language needs for the text. The language that needs fewest bits per letter wins.

Labelled text is a bounded sample of labelled rows, the only thing learned: rows are picked by a hash of their id (so the
pick doesn't depend on order or place), about ``train_docs`` for each language, and used whole, in that order, as long as
their characters come to ``train_chars`` at most; rows longer than that are not picked (where a language has no others,
its shortest one is the sample). Repeated ids and equal texts count once. The sample doesn't grow with the corpus and
only it travels to the workers, each of which builds the automata once. Every letter of the sample has its own code.

Prediction reads whole texts. Windows of ``WINDOW`` characters of many texts walk the automata in lockstep in numpy, each
as if a phrase began with it; then every window goes on beyond its end until one of its phrases begins where a phrase of
a later window begins, from where on that window's phrases are the text's. So the phrases are those of the uncut text.

Defined results: null texts and texts without a letter are ``und`` with score 0. With nothing to learn from, every
text is ``und``. Equal bits go to the alphabetically first language. The score is the winner's share of
2^(-bits / TEMPER) over all languages. Rows without an id are neither learned from nor held out. Rows are independent:
repeated rows get repeated results; extra columns pass through and columns that clash with output names are replaced.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.memory import trimmed

TRAIN_DOCS = 192
TRAIN_CHARS = 32_000
WINDOW = 1024
BATCH_CHARS = 4_000_000
TEMPER = 24.0
FEW = 48
UNKNOWN = "und"
_BREAK, _OTHER = 0, 1
_PLANES = 0x30000  # code points looked up in a table; rarer ones one by one


class Automaton:
    """The suffix automaton of a coded text. Its transitions are kept as displaced rows: a state is the place of its row,
    and its transition by code c is ``target[state + c]`` if ``check[state + c]`` is the state, else the text lacks the
    phrase. The root (state 0) has a row of its own, with 0 for codes that the text lacks altogether, and no entry among
    the displaced ones. Rows are put at pseudo-random places until they fit, the longest first."""

    def __init__(self, codes: list[int], width: int):
        nexts = _suffix_states(codes)
        self.bits = math.log2(max(2, len(codes)))
        size = int(2.2 * sum(map(len, nexts))) + 8 * width + 64
        check, place, taken, draw = [-1] * (size + width), [0] * len(nexts), {0}, 1
        for state in sorted(range(1, len(nexts)), key=lambda s: -len(nexts[s])):
            row = list(nexts[state])
            while True:
                draw = (draw * 1103515245 + 12345) & 0x7FFFFFFF
                at = (draw >> 7) % size
                if at not in taken and all(check[at + c] < 0 for c in row):
                    break
            taken.add(at)
            place[state] = at
            for c in row:
                check[at + c] = at
        self.check, self.target = np.array(check, dtype=np.int32), np.zeros(size + width, dtype=np.int32)
        self.root = np.zeros(width, dtype=np.int32)
        for state, row in enumerate(nexts):
            for code, to in row.items():
                if state:
                    self.target[place[state] + code] = place[to]
                else:
                    self.root[code] = place[to]

        self.rows = tuple(array("i", x.tobytes()) for x in (self.check, self.target, self.root))

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase begins with this code)."""
        at = state + code
        begins = self.check[at] != state
        return np.where(begins, self.root[code], self.target[at]), begins


def _suffix_states(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton's states."""
    links, lengths, nexts, last = [-1], [0], [{}], 0
    for code in codes:
        new = len(lengths)
        lengths.append(lengths[last] + 1)
        links.append(0)
        nexts.append({})
        at = last
        while at != -1 and code not in nexts[at]:
            nexts[at][code] = new
            at = links[at]
        if at != -1:
            target = nexts[at][code]
            if lengths[at] + 1 == lengths[target]:
                links[new] = target
            else:
                clone = len(lengths)
                lengths.append(lengths[at] + 1)
                links.append(links[target])
                nexts.append(dict(nexts[target]))
                while at != -1 and nexts[at].get(code) == target:
                    nexts[at][code] = clone
                    at = links[at]
                links[target] = links[new] = clone
        last = new
    return nexts


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, list[tuple[int, str]]]:
    """Classes of the code points before any letter has a code, and the letters with another lower-case form."""
    chars = [chr(cp) for cp in range(_PLANES)]
    classes = np.array([_OTHER if c.isalpha() else _BREAK for c in chars], dtype=np.int32)
    return classes, [(ord(c), c.lower()[0]) for c in chars if c.lower()[0] != c]


class Model:
    """Automata of the sample texts {language: text}."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        found = {c.lower()[0] for text in samples.values() for c in set(text) if c.isalpha()}
        self.codes = {c: i + 2 for i, c in enumerate(sorted(found))}
        classes, cased = _letters()
        self.classes = classes.copy()
        for c, code in self.codes.items():
            if ord(c) < _PLANES:
                self.classes[ord(c)] = code
        for cp, low in cased:
            if low in self.codes:
                self.classes[cp] = self.codes[low]
        self.automata = [Automaton(self.encode(samples[k]).tolist(), len(self.codes) + 2) for k in self.languages]
        self.bits = [a.bits for a in self.automata]

    def encode(self, text: str) -> np.ndarray:
        """Codes of the characters; a run of characters that are no letters counts once. Letters that no sample has
        share a code, as none of them continues a phrase."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.classes[np.minimum(points, _PLANES - 1)]
        for i in np.flatnonzero(points >= _PLANES):
            char = chr(points[i])
            codes[i] = self.codes.get(char.lower()[0], _OTHER) if char.isalpha() else _BREAK
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != _BREAK) | (codes[:-1] != _BREAK)
        return codes[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrase counts, a row for each text and a column for each language."""
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        pieces = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(len(texts)), pieces)
        if not len(owner):
            return out
        first = np.cumsum(pieces) - pieces  # window of each text
        ends = np.cumsum(lengths)
        flat = np.concatenate(texts).astype(np.int32)
        begin = (ends - lengths)[owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
        size = np.minimum(ends[owner] - begin, WINDOW)
        # lanes: the windows, longest first, so that those still walking are the first ones
        order = np.argsort(-size, kind="stable")
        lane = np.empty_like(order)
        lane[order] = np.arange(len(order))
        active = len(size) - np.searchsorted(size[order][::-1], np.arange(int(size.max())), side="right")
        steps = np.zeros((len(active), len(size)), dtype=np.int32)  # the t-th code of each lane
        for t, n in enumerate(active):
            steps[t, :n] = flat[begin[order[:n]] + t]
        followed = np.flatnonzero(begin + size < ends[owner])
        for k, machine in enumerate(self.automata):
            state = np.zeros(len(size), dtype=np.int32)
            starts = np.zeros(steps.shape, dtype=bool)
            for t, n in enumerate(active):
                state[:n], starts[t, :n] = machine.step(state[:n], steps[t, :n])
            own = np.bincount(order, weights=starts.sum(axis=0), minlength=len(size)).astype(np.int64)
            more, joined, place = self._beyond(machine, flat, owner, first, ends, lane, starts, followed, begin + size, state[lane])
            single = pieces == 1
            out[single, k] = own[first[single]]
            for i in np.flatnonzero(pieces > 1):
                window, at, n = int(first[i]), 0, 0
                while window >= 0:
                    n += own[window] + more[window] - (int(starts[:at, lane[window]].sum()) if at else 0)
                    window, at = int(joined[window]), int(place[window])
                out[i, k] = n
        return out

    @staticmethod
    def _beyond(machine, flat, owner, first, ends, lane, starts, open_windows, at, state) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window: how many phrases begin beyond its end before one that a later window has as well, and that
        window (-1: none) and the place in it."""
        more, joined, place = np.zeros(len(owner), np.int64), np.full(len(owner), -1, np.int64), np.zeros(len(owner), np.int64)
        window, at, state = open_windows, at[open_windows], state[open_windows]
        begin = ends - np.diff(ends, prepend=0)
        check, target, root = machine.rows
        while len(window) > FEW:
            state, fresh = machine.step(state, flat[at])
            text = owner[window]
            offset = at - begin[text]
            there, inside = first[text] + offset // WINDOW, offset % WINDOW
            meets = fresh & starts[inside, lane[there]]
            joined[window[meets]], place[window[meets]] = there[meets], inside[meets]
            more[window[fresh & ~meets]] += 1
            at = at + 1
            goes_on = ~meets & (at < ends[text])
            window, at, state = window[goes_on], at[goes_on], state[goes_on]
        for w, p, s in zip(window.tolist(), at.tolist(), state.tolist(), strict=True):  # long phrases: character by character
            text = owner[w]
            while p < ends[text] and joined[w] < 0:
                for p, code in enumerate(flat[p : min(p + 4096, ends[text])].tolist(), p):
                    if check[s + code] == s:
                        s = target[s + code]
                        continue
                    s = root[code]
                    there, inside = first[text] + (p - begin[text]) // WINDOW, (p - begin[text]) % WINDOW
                    if starts[inside, lane[there]]:
                        joined[w], place[w] = there, inside
                        break
                    more[w] += 1
                p += 1
        return more, joined, place

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [self.encode(t or "") for t in texts]
        letters = [bool((c != _BREAK).any()) for c in codes]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cost = self.phrases(codes) * np.array(self.bits)[None, :]
        best = cost.argmin(axis=1)
        share = np.exp2((cost.min(axis=1)[:, None] - cost) / TEMPER)
        score = 1.0 / share.sum(axis=1)
        languages = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
        return languages, [float(s) if ok else 0.0 for s, ok in zip(score, letters, strict=True)]


@lru_cache(maxsize=2)
def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(dict(samples))


def is_training(doc_id: str = "doc_id") -> F.Column:
    """Rows to learn from: crc32 of the id as text leaves a remainder by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(~is_training(doc_id), F.lit(False))


def sample_texts(df: DataFrame, text: str, label: str, key: str, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> dict[str, str]:
    """The labelled sample: {language: whole texts, about ``train_docs`` rows and ``train_chars`` characters at most}.
    ``df`` holds rows to learn from only."""
    known = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    size = F.length(text)
    stats = known.groupBy(label).agg(F.count(F.when(size <= train_chars, 1)).alias("n")).collect()  # a row a language
    if not stats:
        return {}
    rank = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    chosen = F.lit(False)
    for row in stats:
        if row["n"]:
            chosen = chosen | ((F.col(label) == row[label]) & (size <= train_chars) & (rank <= int(min(1.0, train_docs / row["n"]) * (1 << 30))))
    rows = known.filter(chosen).groupBy(label, rank.alias("__rank"), key).agg(F.min(text).alias("__text"))  # repeated ids once
    texts: dict[str, dict[str, None]] = {}
    room: dict[str, int] = {}
    for row in sorted(rows.collect(), key=lambda r: (r[label], r["__rank"], r[key])):
        own, left = texts.setdefault(row[label], {}), room.get(row[label], train_chars)
        if row["__text"] not in own and len(row["__text"]) <= left:
            own[row["__text"]] = None
            room[row[label]] = left - len(row["__text"]) - 1
    out = {k: "\n".join(v) for k, v in texts.items()}
    lone = [row[label] for row in stats if not row["n"]]
    if lone:
        shortest = known.filter(F.col(label).isin(lone)).groupBy(label).agg(F.min_by(text, F.struct(size, F.col(key))).alias("__text"))
        out |= {row[label]: row["__text"] for row in shortest.collect()}
    return out


def identify(
    df: DataFrame, samples: dict[str, str], text: str = "text", language: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """``df`` with the predicted language of each whole text and its score; one map pass, the text is kept."""
    model_key = tuple(sorted(samples.items()))
    kept = [c for c in df.columns if c not in (language, score)]
    schema = T.StructType(
        [df.schema[c] for c in kept] + [T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())]
    )
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_key)
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                hi, chars, texts = lo, 0, []
                while hi < batch.num_rows and chars < BATCH_CHARS:
                    texts.append(batch.column(at)[hi].as_py())
                    chars += len(texts[-1] or "") + 1
                    hi += 1
                languages, scores = model.predict(texts)
                columns = [c.slice(lo, hi - lo) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*kept, language, score])
                lo = hi

    return df.select(*kept).mapInArrow(trimmed(run), schema)


def predictions(df: DataFrame) -> DataFrame:
    """The contract columns of the query: learn from the rows in training, predict for all."""
    samples = sample_texts(df.filter(is_training()), "text", "lang", "doc_id")
    out = identify(df.select("doc_id", "text"), samples)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame) -> DataFrame:
    """The filtering form: ``df`` without the documents whose language can't be told (``und``)."""
    columns = df.columns
    samples = sample_texts(df.filter(is_training()), "text", "lang", "doc_id")
    return identify(df, samples, language="__language", score="__score").filter(F.col("__language") != UNKNOWN).select(*columns)
