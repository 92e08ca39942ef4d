"""Operator 2: secret scans, with DataFrame functions only.

Base spans, per kind the leftmost matches that don't overlap: ``assign`` (a name such as ``password`` or ``api_key``
set to a value of 12 or more characters), ``access`` (``AKIA`` keys of 18 or more characters) and ``hex`` (runs of 16
or more of 0-9a-f). Added spans, kind ``entropy``: candidate strings (runs of 20 or more key characters that hold both
a digit and a letter) in which some window of ``WINDOW`` characters has a Shannon entropy of at least the limit of the
string's character class (hex, upper-case alphanumeric, alphanumeric, base64). The window slides by one character at a
time; its counts and its sum of n*log2(n) change by the character that leaves and the one that enters only.
Candidates on the allow-list (UUIDs, dates, versions, paths, placeholder strings, long runs of one character) and those
that touch a base span are not added. Suppression never removes a base span.

Offsets are code points, the end is exclusive, a span covers the whole match. Positions come from the text's split at
the matches: the lengths of the gaps and of the matches add up to the offsets. The work grows with the text's length,
whatever it holds: no pattern recurses, no list is copied for each match, no candidate is compared with every span.

Null texts count as empty and have no spans. Spans are sorted by start, then kind in the order above. Repeated rows get
repeated results; extra columns pass through; columns that clash with output names are replaced. No shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Runs of the alphabet, or of what stands for an assigned value.
MARK = "\x01"
CANDIDATE = r"[A-Za-z0-9+/_=\x01-]{20,}"
WINDOW = 20
#: Least entropy in bits of a window, by character class.
LIMITS = {"hex": 3.0, "upper": 3.4, "alnum": 3.6, "base64": 3.7}
#: A string that one of these finds is no secret. Groups repeat possessively: other repeats recurse once a repeat.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"^v?[0-9]++(?:[-_][0-9]++)++$",
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|abcdefgh|12345678",
    r"(.)\1{7}",
    r"^/?(?:[A-Za-z]++[0-9]{0,2}[/_-])++[A-Za-z]*[0-9]{0,2}$",
)
BLOCK = 512

KINDS = ("assign", "access", "hex", "entropy")
_SPAN = "struct<s:int,e:int,m:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(text: Column, pattern: str) -> Column:
    """array<struct<gap, m>>: the matches, each with the text before it; the last gap has no match. Null without any."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))))


def _spans(pieces: Column) -> Column:
    """array<struct<s, e, m>> of the matches (null: none): running sums of lengths, by blocks, so that the list built so far is
    copied once for each block and not for each match."""
    rows = F.transform(
        F.filter(pieces, lambda x: x["m"].isNotNull()),
        lambda x: F.struct(F.length(x["gap"]).alias("g"), F.length(x["m"]).alias("n"), x["m"].alias("m")),
    )

    def match(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + x["n"]
        span = F.struct(begin.alias("s"), end.alias("e"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def block(acc: Column, rows: Column) -> Column:
        inner = F.aggregate(rows, F.struct(acc["at"].alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")), match)
        return _let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def summed(rows: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int"))
        blocks = F.transform(starts, lambda b: F.slice(rows, b * BLOCK + 1, BLOCK))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
        found = F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(rows) > 0, found).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return F.when(pieces.isNotNull(), _let(rows, summed)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _klogk(k: Column) -> Column:
    table = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 1)])
    return F.get(table, k)


_PACKED = 12  # counts of five bits in one 64-bit integer


def window_entropy(word: Column) -> Column:
    """The largest Shannon entropy, in bits, of a window of ``WINDOW`` characters that slides over the word (of at least
    so many characters of the alphabet).

    The window's counts are kept packed, five bits for each character of the alphabet. A step adds one to the count of
    the character that enters and takes one from that of the character that leaves, and moves the sum of n*log2(n) by
    these two counts. While the window fills, nothing leaves."""
    places = [0] * 128
    for i, c in enumerate(ALPHABET):
        places[ord(c)] = i
    code = F.array(*[F.lit(i) for i in places])
    none = F.lit(0).cast("long")

    def place(i: Column) -> Column:
        return F.struct(F.floor(i / _PACKED).cast("int").alias("k"), (i % _PACKED * 5).alias("s"))

    def moves(codes: Column) -> Column:
        late = F.concat(F.array_repeat(F.lit(None).cast("int"), WINDOW), F.slice(codes, 1, F.greatest(F.size(codes) - WINDOW, F.lit(0))))
        steps = F.zip_with(codes, late, lambda i, o: F.struct(place(i).alias("enters"), F.when(o.isNotNull(), place(o)).alias("leaves")))
        return F.slice(steps, 1, F.size(codes))

    def count(acc: Column, at: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.get(acc["counts"], at["k"]), at["s"]).bitwiseAND(F.lit(31)).cast("int")

    def change(at: Column, k: Column) -> Column:
        return F.when(at["k"] == k, F.call_function("shiftleft", F.lit(1).cast("long"), at["s"])).otherwise(none)

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        more, fewer = count(acc, enters), count(acc, leaves)
        up = _klogk(more + 1) - _klogk(more)
        sums = F.when(leaves.isNull(), acc["sum"] + up).when(enters == leaves, acc["sum"]).otherwise(acc["sum"] + up + _klogk(fewer - 1) - _klogk(fewer))
        counts = F.transform(acc["counts"], lambda c, k: c + change(enters, k) - change(leaves, k))
        return F.struct(counts.alias("counts"), sums.alias("sum"), (acc["n"] + 1).alias("n"), least(acc).alias("least"))

    def least(acc: Column) -> Column:
        return F.when(acc["n"] >= WINDOW, F.least(acc["least"], acc["sum"])).otherwise(acc["least"])

    empty = F.array_repeat(none, -(-len(ALPHABET) // _PACKED))
    start = F.struct(empty.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(float("inf")).alias("least"))
    codes = F.transform(F.split(word, ""), lambda c: F.get(code, F.ascii(c)))
    return _let(codes, lambda c: F.aggregate(moves(c), start, step, lambda acc: F.lit(math.log2(WINDOW)) - least(acc) / WINDOW))


def _limit(word: Column) -> Column:
    return (
        F.when(word.rlike("^[0-9a-f]+$") | word.rlike("^[0-9A-F]+$"), LIMITS["hex"])
        .when(word.rlike("^[0-9A-Z]+$"), LIMITS["upper"])
        .when(word.rlike("^[0-9A-Za-z]+$"), LIMITS["alnum"])
        .otherwise(LIMITS["base64"])
    )


def _is_secret(word: Column) -> Column:
    """A candidate that holds a digit and a letter and no base span, isn't allowed and has a window of high entropy."""
    # access keys and hex runs lie inside candidates as a whole; an assigned value is marked
    apart = ~F.contains(word, F.lit(MARK)) & ~word.rlike(f"[0-9a-f]{{{HEX_MIN}}}") & ~word.rlike(f"AKIA[A-Z0-9]{{{ACCESS_MIN - 4}}}")
    plausible = apart & word.rlike("[0-9]") & word.rlike("[A-Za-z]")
    for pattern in ALLOWED:
        plausible = plausible & ~word.rlike(pattern)
    return F.when(plausible, window_entropy(word) >= _limit(word)).otherwise(False)


def scan(df: DataFrame, text: str = "text", spans: str = "secret_spans") -> DataFrame:
    """``df`` with ``spans``: an array of (start, end, kind number) of all spans, sorted."""
    found = df.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    source = F.col("__text")

    def is_assign(match: Column) -> Column:
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_MIN

    def marked(x: Column) -> Column:
        value = F.when(x["m"].isNull(), "").when(is_assign(x["m"]), F.repeat(F.lit(MARK), F.length(x["m"]))).otherwise(x["m"])
        return F.concat(F.translate(x["gap"], MARK, " "), value)

    found = found.withColumn("__pieces", _pieces(source, ASSIGN))
    found = found.withColumn("__marked", F.coalesce(F.array_join(F.transform("__pieces", marked), ""), F.translate(source, MARK, " ")))
    found = found.withColumns(
        {
            "__assign": F.filter(_spans(F.col("__pieces")), lambda x: is_assign(x["m"])),
            "__access": F.filter(_spans(_pieces(source, ACCESS)), lambda x: x["e"] - x["s"] >= ACCESS_MIN),
            # runs that are too short are never matched here: no longer match can begin inside one
            "__hex": _spans(_pieces(source, HEX.replace("+", f"{{{HEX_MIN},}}"))),
            "__entropy": F.filter(_spans(_pieces(F.col("__marked"), CANDIDATE)), lambda x: _is_secret(x["m"])),
        }
    )

    def of_kind(n: int) -> Column:
        return F.transform(f"__{KINDS[n]}", lambda x: F.struct(x["s"].alias("start"), F.lit(n).alias("kind"), x["e"].alias("end")))

    parts = [of_kind(n) for n in range(len(KINDS))]
    return found.withColumn(spans, F.array_sort(F.concat(*parts))).drop("__text", "__pieces", "__marked", "__assign", "__access", "__hex", "__entropy")


def listing(df: DataFrame) -> DataFrame:
    """The contract columns of the query."""
    out = scan(df.select("doc_id", "text"))
    spans = F.col("secret_spans")
    names = F.array(*[F.lit(k) for k in KINDS])

    def text_of(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(n: int) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == n)).cast("long")

    base = text_of(F.filter(spans, lambda x: x["kind"] < 3))
    return out.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        text_of(spans).alias("spans"),
        count(3).alias("n_entropy"),
    )
