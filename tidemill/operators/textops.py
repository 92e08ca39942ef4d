"""Documents per key, vocabularies, padded sequences, overlap metrics and HTML fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAD, UNK = 0, 1


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def words(c: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "\\s+"), lambda w: w != "")


def doc_concat(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """One text for each key, its parts in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return df.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("doc"))


def vocabulary(df: DataFrame, text: str, size: int) -> DataFrame:
    """The most frequent tokens with ids from 2; ties in token order. 0 is padding, 1 unknown."""
    counts = df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "token").limit(size)
    return best.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 1).cast("bigint"))  # ``size`` rows


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame, length: int, buckets: int = 256) -> DataFrame:
    """(key, seq, n): token ids, cut or padded to a length, and the number of tokens. Only tokens that stay are looked up.
    The vocabulary has a fixed size and is broadcast as one row, its tokens by hash bucket (maps are searched linearly)."""
    from tidemill.functions.clean import pad

    def bucket(token: Column) -> Column:
        return F.pmod(F.hash(token), F.lit(buckets))

    held = vocab.groupBy(bucket(F.col("token")).alias("b")).agg(F.collect_list(F.struct("token", "id")).alias("held"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(held, "b", "left")
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "held"))), lambda x: x["held"]).alias("table"))
    rows = df.select(key, tokens(F.col(text)).alias("words")).join(F.broadcast(table))

    def code(word: Column) -> Column:
        found = F.filter(F.get("table", bucket(word)), lambda x: x["token"] == word)
        return F.coalesce(F.get(found, F.lit(0))["id"], F.lit(UNK).cast("bigint"))

    rows = rows.select(key, F.slice("words", 1, length).alias("first"), F.size("words").cast("bigint").alias("n"), "table")
    return rows.select(key, pad(F.transform("first", code), length).alias("seq"), "n")


def unk_ratio(encoded: DataFrame) -> DataFrame:
    """Share of unknown ids among those that aren't padding; 0 where there are none."""
    known = F.filter("seq", lambda x: x != PAD)
    parts = encoded.agg(F.sum(F.size(known)).alias("n"), F.sum(F.size(F.filter("seq", lambda x: x == UNK))).alias("unk"))
    return parts.select(F.round(F.coalesce(F.col("unk") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), 6).alias("unk_ratio"))


def coverage(df: DataFrame, text: str, vocab: DataFrame) -> DataFrame:
    """Share of distinct tokens that the vocabulary has."""
    found = df.select(F.explode(tokens(F.col(text))).alias("token")).distinct().join(F.broadcast(vocab.select("token", "id")), "token", "left")
    return found.agg(F.round(F.avg(F.col("id").isNotNull().cast("double")), 6).alias("coverage"))


def ngrams(c: Column, n: int) -> Column:
    count = F.greatest(F.size(c) - n + 1, F.lit(0))
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(c, i, n), " "))


def _grams(pairs: DataFrame, key: str, candidate: str, reference: str, n: int) -> DataFrame:
    """(key, gram, c, r): how often each n-gram occurs on either side. Counts combine on the map side."""

    def side(column: str, c: int, r: int) -> Column:
        words = tokens(F.col(column))
        return F.transform(words if n == 1 else ngrams(words, n), lambda g: F.struct(g.alias("gram"), F.lit(c).alias("c"), F.lit(r).alias("r")))

    rows = pairs.select(key, F.explode(F.concat(side(candidate, 1, 0), side(reference, 0, 1))).alias("x")).select(key, "x.*")
    return rows.groupBy(key, "gram").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))


def _totals() -> list[Column]:
    return [F.sum("c").alias("cand"), F.sum("r").alias("ref"), F.sum(F.least("c", "r")).alias("hits")]


def overlap(pairs: DataFrame, key: str, candidate: str, reference: str, n: int) -> DataFrame:
    """(key, cand, ref, hits): n-gram counts of both sides and the clipped overlap."""
    return _grams(pairs, key, candidate, reference, n).groupBy(key).agg(*_totals())


def bleu1(pairs: DataFrame, key: str, candidate: str, reference: str, smooth: float | None = None) -> DataFrame:
    """Corpus BLEU with unigrams: clipped precision times brevity penalty. ``smooth`` stands for no hits at all."""
    total = _grams(pairs, key, candidate, reference, 1).agg(*_totals())
    hits = F.col("hits") if smooth is None else F.when(F.col("hits") == 0, F.lit(smooth)).otherwise(F.col("hits"))
    brevity = F.when(F.col("cand") >= F.col("ref"), 1.0).otherwise(F.exp(1 - F.col("ref") / F.nullif(F.col("cand"), F.lit(0))))
    return total.select(F.round(brevity * hits / F.nullif(F.col("cand"), F.lit(0)), 6).alias("bleu1"))


def rouge_n(pairs: DataFrame, key: str, candidate: str, reference: str, n: int) -> DataFrame:
    """Mean precision, recall and F1 of the clipped n-gram overlap."""
    rows = overlap(pairs, key, candidate, reference, n)
    p = F.coalesce(F.col("hits") / F.nullif(F.col("cand"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("hits") / F.nullif(F.col("ref"), F.lit(0)), F.lit(0.0))
    rows = rows.select(p.alias("p"), r.alias("r"))
    f = F.coalesce(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0))
    return rows.agg(F.round(F.avg("p"), 6).alias("p"), F.round(F.avg("r"), 6).alias("r"), F.round(F.avg(f), 6).alias("f1"))


# --- metrics beyond SQL, in Arrow batches ----------------------------------------------------------------------------
_TOKEN = re.compile(r"[^\W_]+")


def _split(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | (1 << i)
    row = (1 << len(a)) - 1
    full = row
    for word in b:
        match = row & places.get(word, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def rouge_l_score(candidate: str | None, reference: str | None) -> float:
    a, b = _split(candidate), _split(reference)
    common = lcs_length(a, b) if a and b else 0
    return 2 * common / (len(a) + len(b)) if common else 0.0


VOWELS = "aeiouyáàâäéèêëíìîïóòôöúùûü"


def fkgl(c: Column) -> Column:
    """Flesch-Kincaid grade; null without words. A word has as many syllables as groups of vowels, a final silent e not
    counted, one at least; all counts are counts of matches."""
    text = F.lower(F.coalesce(c, F.lit("")))
    letter, other = "[\\p{L}\\p{N}]", f"[\\p{{L}}\\p{{N}}&&[^{VOWELS}]]"

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    n = count(f"{letter}+")
    silent = count(f"[{VOWELS}]{other}+[{VOWELS}]*(?<=e)(?!{letter})")
    syllables = count(f"[{VOWELS}]+") + count(f"(?<!{letter}){other}++(?!{letter})") - silent
    sentences = F.greatest(F.lit(1), count("[^.!?\\s][^.!?]*"))
    return F.when(n > 0, F.round(0.39 * n / sentences + 11.8 * syllables / n - 15.59, 6))


def sari(df: DataFrame, key: str, source: str, candidate: str, reference: str) -> DataFrame:
    """(key, sari): mean over n = 1..4 of F1 for kept and added n-grams and precision for deleted ones, in percent, over
    sets of n-grams."""

    def f1(good: Column, made: Column, wanted: Column) -> Column:
        p = F.coalesce(good / F.nullif(made, F.lit(0)), F.lit(0.0))
        q = F.coalesce(good / F.nullif(wanted, F.lit(0)), F.lit(0.0))
        return F.when((made == 0) & (wanted == 0), 1.0).otherwise(F.coalesce(2 * p * q / F.nullif(p + q, F.lit(0.0)), F.lit(0.0)))

    def both(a: str, b: str) -> Column:
        return F.array_intersect(a, b)

    def without(a: str, b: str) -> Column:
        return F.array_except(a, b)

    words = df.select(key, *[tokens(F.col(c)).alias(name) for name, c in (("ws", source), ("wc", candidate), ("wr", reference))])
    total = F.lit(0.0)
    for n in range(1, 5):
        words = words.withColumns({f"{x}{n}": F.array_distinct(ngrams(F.col(f"w{x}"), n)) for x in "scr"})
        s, c, r = (f"{x}{n}" for x in "scr")
        keep = f1(F.size(F.array_intersect(both(s, c), r)), F.size(both(s, c)), F.size(both(s, r)))
        add = f1(F.size(F.array_except(both(c, r), s)), F.size(without(c, s)), F.size(without(r, s)))
        gone = F.size(without(s, c))
        delete = F.when(gone > 0, F.size(F.array_except(without(s, c), r)) / gone).otherwise(F.when(F.size(without(s, r)) == 0, 1.0).otherwise(0.0))
        total = total + (keep + add + delete) / 3
    return words.select(key, F.round(100 * total / 4, 6).alias("sari"))


def scored(df: DataFrame, key: str, name: str, function, *columns: str) -> DataFrame:
    """(key, name): a Python score of text columns, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [function(*row) for row in batch[list(columns)].itertuples(index=False)]
            yield pd.DataFrame({key: batch[key], name: pd.Series(values, dtype="float64").round(6)})

    return df.select(key, *columns).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {name} double")


# --- HTML --------------------------------------------------------------------------------------------------------------
def html_fields(df: DataFrame, key: str, html: str, fields: dict[str, str]) -> DataFrame:
    """Fields of pages by patterns with one group; what a page lacks is null."""
    value = {name: F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), pattern, 1), F.lit("")).alias(name) for name, pattern in fields.items()}
    return df.select(key, *value.values())


def select_html(html: str | None, tag: str, class_name: str | None = None) -> list[str]:
    """Texts of the elements with a tag and class, by a real parser: for pages that patterns can't read."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.open: list[list[str]] = []
            self.depth: list[int] = []
            self.level, self.out = 0, []

        def handle_starttag(self, name, attrs):
            self.level += 1
            classes = (dict(attrs).get("class") or "").split()
            if name == tag and (class_name is None or class_name in classes):
                self.open.append([])
                self.depth.append(self.level)

        def handle_endtag(self, name):
            if self.depth and name == tag and self.level == self.depth[-1]:
                self.out.append("".join(self.open.pop()))
                self.depth.pop()
            self.level -= 1

        def handle_data(self, data):
            for part in self.open:
                part.append(data)

    reader = Reader()
    reader.feed(html or "")
    return reader.out


def counted(df: DataFrame, key: str, html: str, tag: str, name: str) -> DataFrame:
    """(key, name): the number of elements with a tag, closed or not."""
    from html.parser import HTMLParser

    class Counter(HTMLParser):
        found = 0

        def handle_starttag(self, name, attrs):
            self.found += name == tag

    def count(text: str | None) -> int:
        reader = Counter()
        reader.feed(text or "")
        return reader.found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], name: [count(t) for t in batch[html]]})

    return df.select(key, html).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {name} long")


def assembled(df: DataFrame, key: str, original: str, generated: str, human: str | None = None) -> DataFrame:
    """The output table: original, human text if the table has one, generated text."""
    columns = [key, original, *([human] if human and human in df.columns else []), generated]
    return df.select(*columns)


def mask(c: Column) -> Column:
    """E-mail addresses and phone-like digit groups masked."""
    return F.regexp_replace(F.regexp_replace(c, "[\\w.+-]+@[\\w-]+\\.[\\w.]+", "[EMAIL]"), "\\+?\\d[\\d ()-]{7,}\\d", "[PHONE]")
