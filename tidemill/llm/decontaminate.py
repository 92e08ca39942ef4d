"""Operator 6: benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become templates: numbers turn into ``#``, units behind numbers into ``~``, names (capitalised words inside a
sentence) into ``@``, the rest into lower-case words. Windows of ``WINDOW`` template words (``SHORT_WINDOW`` for items
under ``SHORT`` words, so that a changed word breaks fewer of their windows; the whole item where it is shorter still) are
hashed and joined with the windows of the benchmark items; a re-parameterised question has the same windows. A document
is contaminated by an item if at least ``COVERAGE`` of the item's distinct windows occur in it, or ``RUN`` template words
in a row, and the slots are consistent: over the matched windows, every slot value of the item stands for one value of the document
(at least ``CONSISTENT`` of the item's matched slots do). Both are asked of each alignment by itself: the windows of one
shift of the document against the item, of a range of ``BAND`` shifts (words put in or left out), or the first place of
every window; one alignment that passes is enough, and the one that matches most is listed.

The documents' windows, of all lengths in one pass, meet the benchmark's in a join on the hash. The benchmark's windows,
and the ids of contaminated documents, are broadcast only while they are at most ``BROADCAST_ROWS``; beyond that the
joins shuffle. Only what matched is grouped, with
map-side combine; slots are read again for matched documents only.

Defined results: null and empty texts match nothing; items without words are ignored; items with equal texts each
count; windows without any plain word are not compared. Repeated rows of an id are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.runtime import materialize

WINDOW = 8
SHORT_WINDOW = 4
SHORT = 48
RUN = 24
COVERAGE = 0.6
CONSISTENT = 0.8
BAND = 16
BROADCAST_ROWS = 500_000

NUMBER = r"\p{N}++(?:[.,:/]\p{N}++)*+"  # possessive: other repeats of a group recurse once a repeat
# Unit words and signs that may follow a number.
UNITS = (
    "km|kilometers?|kilometres?|m|meters?|metres?|cm|mm|miles?|feet|foot|ft|inches|inch|kg|kilograms?|g|grams?|mg|lbs?|pounds?|"
    "tons?|liters?|litres?|l|ml|hours?|hrs?|h|minutes?|mins?|min|seconds?|secs?|s|days?|weeks?|months?|years?|dollars?|cents?|"
    "euros?|usd|eur|percent|degrees?|mph|kmh|kw|kwh|w|watts?|volts?|hz|mhz|ghz|mb|gb|tb"
)
UNIT = rf"(# +)(?:(?i:{UNITS})(?![\p{{L}}])|[%€$£°])"
NAME = r"\p{Lu}(?<=[\p{Ll}#~,;:] \p{Lu})\p{Ll}+"


def _numbers_out(text: Column) -> Column:
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), "#~@", "   ")
    return F.regexp_replace(plain, NUMBER, " # ")


def template(text: Column) -> Column:
    """The template words of a text."""
    typed = F.regexp_replace(F.regexp_replace(_numbers_out(text), UNIT, "$1~ "), NAME, "@")
    return F.filter(F.split(F.lower(typed), r"[^\p{L}#~@]+"), lambda w: w != "")


def slots(text: Column) -> Column:
    """The values behind the template's slots, by kind, in order."""
    numbers = F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), "#~@", "   "), F.lit(NUMBER), F.lit(0))
    counted = _numbers_out(text)
    units = F.transform(F.regexp_extract_all(counted, F.lit(UNIT), F.lit(0)), lambda u: F.lower(F.regexp_replace(u, "^# +", "")))
    names = F.regexp_extract_all(F.regexp_replace(counted, UNIT, "$1~ "), F.lit(NAME), F.lit(0))
    return F.create_map(F.lit("#"), numbers, F.lit("~"), units, F.lit("@"), names)


def _windows(df: DataFrame, lengths: list[int], *kept: str) -> DataFrame:
    """(kept..., size, at, hash): the windows of these lengths of the ``words`` column, in one pass over them."""
    last = F.size("words") - min(lengths)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = df.select(*kept, "words", F.explode(starts).alias("at"))

    def window(size: int) -> Column:
        parts = [F.get(F.col("words"), F.col("at") + i) for i in range(size)]
        return F.struct(F.lit(size).alias("size"), F.when(F.col("at") + size <= F.size("words"), F.xxhash64(*parts)).alias("hash"))

    rows = rows.select(*kept, "at", F.explode(F.array(*map(window, lengths))).alias("w"))
    return rows.select(*kept, "w.size", "at", "w.hash").filter(F.col("hash").isNotNull())


def matches(df: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, at, item_at, size, n_windows): windows of documents that equal windows of items."""
    items = benchmark.select("item_id", template(F.col("text")).alias("words")).filter(F.size("words") > 0)
    least = F.when(F.size("words") < SHORT, F.lit(min(window, SHORT_WINDOW))).otherwise(F.lit(window))
    items = items.withColumn("length", F.least(F.size("words"), least))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most ``window`` values
    if not lengths:
        lengths = [window]
    own = None
    for size in lengths:
        part = _windows(items.filter(F.col("length") == size), [size], "item_id", "words")
        plain = F.exists(F.slice("words", F.col("at") + 1, size), lambda w: ~w.isin("#", "~", "@"))
        part = part.filter(plain).drop("words")
        own = part if own is None else own.unionByName(part)
    totals = own.groupBy("item_id").agg(F.countDistinct("hash").alias("n_windows"))
    own = materialize(own.join(totals, "item_id").withColumnRenamed("at", "item_at"), "benchmark")
    docs = df.select(F.col("doc_id"), template(F.col("text")).alias("words"))
    side = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
    return _windows(docs, lengths, "doc_id").join(side, ["size", "hash"])


def contaminated(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, n_slots, n_consistent): the contaminated pairs."""
    places = matches(df, benchmark, window).select("doc_id", "item_id", "hash", "size", "at", "item_at", "n_windows").distinct()
    places = materialize(places, "matched")
    pair = ["doc_id", "item_id"]
    enough = places.groupBy(*pair).agg(F.countDistinct("hash").alias("n_matched"), F.first("n_windows").alias("n_windows"))
    whole = F.col("n_matched") >= coverage * F.col("n_windows")
    runs = materialize(_runs(places), "runs")
    enough = enough.filter(whole).select(*pair).union(runs.select(*pair)).distinct()
    near = places.join(enough, pair, "left_semi").withColumn("shift", F.col("at") - F.col("item_at"))
    near = materialize(_aligned(near), "aligned")
    groups = near.groupBy(*pair, "align").agg(F.first("n_windows").alias("n_windows"), F.countDistinct("hash").alias("n_matched"))
    groups = groups.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).join(runs.withColumn("run", F.lit(True)), [*pair, "align"], "left")
    groups = groups.filter((F.col("coverage") >= coverage) | F.col("run")).drop("run")
    groups = materialize(groups, "covered")
    # slots, of matched documents and items only
    near = near.join(groups.select(*pair, "align"), [*pair, "align"], "left_semi")
    ids = _ids(groups)
    texts = df.select("doc_id", "text").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    doc_slots = _located(texts, "doc_id", "doc_value").withColumnRenamed("at", "doc_at")
    item_slots = _located(benchmark.select("item_id", "text"), "item_id", "item_value").withColumnRenamed("at", "slot_at")
    slot = near.select(*pair, "align", "shift", F.explode(F.sequence("item_at", F.col("item_at") + F.col("size") - 1)).alias("slot_at")).distinct()
    slot = slot.join(item_slots, ["item_id", "slot_at"]).withColumn("doc_at", F.col("slot_at") + F.col("shift"))
    slot = slot.join(doc_slots, ["doc_id", "doc_at", "kind"])
    by_value = slot.groupBy(*pair, "align", "kind", "item_value").agg(F.countDistinct("doc_value").alias("values"), F.countDistinct("slot_at").alias("n"))
    checked = by_value.groupBy(*pair, "align").agg(F.sum("n").alias("n_slots"), F.sum(F.when(F.col("values") == 1, F.col("n")).otherwise(0)).alias("n_consistent"))
    out = groups.join(checked, [*pair, "align"], "left").fillna(0, ["n_slots", "n_consistent"])
    out = out.filter(F.col("n_consistent") >= CONSISTENT * F.col("n_slots"))
    best = F.max(F.struct("n_matched", "n_consistent", "n_slots", "n_windows", "coverage")).alias("best")
    return out.groupBy(*pair).agg(best).select(*pair, "best.n_windows", "best.n_matched", "best.coverage", "best.n_slots", "best.n_consistent")


def _ids(found: DataFrame) -> DataFrame:
    """The distinct documents, broadcast while they are at most ``BROADCAST_ROWS``: the texts then stay where they are."""
    ids = materialize(found.select("doc_id").distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _runs(places: DataFrame) -> DataFrame:
    """(doc_id, item_id, align): the shifts at which at least ``RUN`` template words in a row agree."""
    key = ["doc_id", "item_id", "shift"]
    rows = places.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "size").distinct()
    long = rows.groupBy(*key).agg((F.count(F.lit(1)) + F.max("size") - 1).alias("words")).filter(F.col("words") >= RUN)
    rows = rows.join(long.select(*key), key, "left_semi")
    island = F.col("item_at") - F.row_number().over(Window.partitionBy(*key).orderBy("item_at"))
    runs = rows.withColumn("island", island).groupBy(*key, "island").agg((F.count(F.lit(1)) + F.max("size") - 1).alias("words"))
    return runs.filter(F.col("words") >= RUN).select("doc_id", "item_id", F.concat(F.lit("s"), "shift").alias("align")).distinct()


def _aligned(places: DataFrame) -> DataFrame:
    """``places`` by alignment (``align``): each shift of document against item, overlapping ranges of shifts, and the
    first place of every window."""
    columns = ["doc_id", "item_id", "hash", "size", "item_at", "shift", "n_windows"]
    shift = F.col("shift")
    keys = F.array(
        F.concat(F.lit("s"), shift), F.concat(F.lit("a"), F.floor(shift / BAND)), F.concat(F.lit("b"), F.floor((shift + BAND // 2) / BAND))
    )
    support = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "item_id", "shift"))
    rows = places.withColumn("support", support).select(*columns, "support", F.explode(keys).alias("align"))
    most = Window.partitionBy("doc_id", "item_id", "align", "item_at").orderBy(F.desc("support"), "shift")  # windows may recur in the item
    rows = rows.withColumn("rank", F.row_number().over(most)).filter(F.col("rank") == 1).select(*columns, "align")
    first = places.groupBy("doc_id", "item_id", "hash").agg(
        F.min("size").alias("size"), F.min("item_at").alias("item_at"), F.min("at").alias("at"), F.min("n_windows").alias("n_windows")
    )
    first = first.withColumn("shift", F.col("at") - F.col("item_at")).select(*columns, F.lit("first").alias("align"))
    return rows.unionByName(first)


def _located(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, at, kind, value): the slots of each text's template, by place."""
    rows = df.select(key, template(F.col("text")).alias("words"), slots(F.col("text")).alias("slots"))

    def of_kind(kind: str) -> Column:
        places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda x: x["w"] == kind)
        pairs = F.zip_with(places, F.try_element_at("slots", F.lit(kind)), lambda x, v: F.struct(x["at"].alias("at"), F.lit(kind).alias("kind"), v.alias("value")))
        return F.filter(pairs, lambda x: x["at"].isNotNull())

    found = F.explode(F.concat(*map(of_kind, ("#", "~", "@"))))
    return rows.select(key, found.alias("x")).select(key, "x.at", "x.kind", F.col("x.value").alias(value))


def listing(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of the query: one row for each contaminated pair."""
    out = contaminated(df, benchmark)
    return out.select(
        "doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.col("n_matched").cast("long").alias("n_matched"),
        F.round("coverage", 6).alias("coverage"), F.col("n_slots").cast("long").alias("n_slots"), F.col("n_consistent").cast("long").alias("n_consistent"),
    )


def keep_clean(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The filtering form: ``df`` without the contaminated documents."""
    return df.join(_ids(contaminated(df, benchmark)), "doc_id", "left_anti").select(*df.columns)
