"""Column functions for cleaning and typing scraped text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BADGE = "다코미식가"
MORE = "...더보기\n"


def clean_text(c: Column) -> Column:
    """Null to empty, line ends to one blank, blanks at both ends off."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\\r\\n|\\r|\\n", " "))


def parse_rating(c: Column) -> Column:
    """``4.5점`` to 4.5; text without digits to null."""
    return F.expr("null") if c is None else F.nullif(F.regexp_replace(c, "[^0-9.]", ""), F.lit("")).try_cast("double")


def parse_korean_date(c: Column) -> Column:
    """``2025년 3월 21일`` to a date; anything else to null."""
    return F.try_to_timestamp(c, F.lit("yyyy년 M월 d일")).cast("date")


def ordinal(c: Column, good: str, fair: str, poor: str) -> Column:
    """Three grades to 2, 1, 0; anything else to null."""
    return F.when(c == good, 2).when(c == fair, 1).when(c == poor, 0)


def badge_flag(c: Column) -> Column:
    return c.contains(BADGE).cast("int")


def without_badge(c: Column) -> Column:
    return F.trim(F.replace(F.replace(c, F.lit(BADGE), F.lit("")), F.lit("\n"), F.lit("")))


def without_more(c: Column) -> Column:
    return F.replace(c, F.lit(MORE), F.lit(""))


def digits_to_int(c: Column) -> Column:
    """All digits of a text as one number; null without digits."""
    return F.nullif(F.array_join(F.regexp_extract_all(c, F.lit("\\d+"), F.lit(0)), ""), F.lit("")).try_cast("bigint")


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def first_token(c: Column) -> Column:
    return F.get(F.split(c, " "), F.lit(0))


def preview(c: Column, n: int = 150) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def min_max(c: Column, low: Column, high: Column) -> Column:
    return (c - low) / F.nullif(high - low, F.lit(0.0))


def from_min_max(c: Column, low: Column, high: Column) -> Column:
    """The inverse of ``min_max``."""
    return c * (high - low) + low


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its largest value."""
    powers = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.get(F.transform(F.array(powers), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda s, y: s + y))), F.lit(0))


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def not_blank(*columns: Column) -> Column:
    """No column is null or made of white space only."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.length(F.trim(F.regexp_replace(c, "\\s+", " "))) > 0, F.lit(False))
    return out


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pad(c: Column, length: int, fill: int = 0) -> Column:
    """Cut or fill an array on the right to a length."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(fill).cast("bigint"), length)), 1, length)


def prompt(original: Column, simplified: Column) -> Column:
    """The training prompt; null if either side is."""
    text = F.concat(F.lit("<start_of_turn>user\n"), original, F.lit("<end_of_turn>\n<start_of_turn>model\n"), simplified, F.lit("<end_of_turn>"))
    return F.when(original.isNotNull() & simplified.isNotNull(), text)


def response(generated: Column, asked: Column, tag: str = "<start_of_turn>model\n") -> Column:
    """The answer in a generated text: behind the last model tag, else (where the text holds the prompt ``asked``) without
    as many leading characters as the prompt has, else all of it; cut at the first end mark and stripped."""
    tail = (
        F.when(generated.contains(tag), F.substring_index(generated, tag, -1))
        .when(generated.contains(asked), F.substring(generated, F.length(asked) + 1, F.length(generated)))
        .otherwise(generated)
    )
    ends = [F.nullif(F.locate(mark, tail), F.lit(0)) for mark in ("<eos>", "<end_of_turn>")]
    end = F.coalesce(F.least(*ends), F.length(tail) + 1)
    return F.regexp_replace(F.substring(tail, F.lit(1), end - 1), "^\\s+|\\s+$", "")
