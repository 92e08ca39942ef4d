"""Readers with declared schemas, and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS = "user int, item int, rating double, timestamp long"
REVIEWS = (
    "id int, item_name string, item_area string, item_avg_rating string, item_spec_area string, user_name string, user_tot_avg_rating string, "
    "user_tot_rating_num string, user_tot_follow_num string, user_rating string, user_query string, taste string, price string, service string, "
    "menu string, reviewed_at string"
)


def csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", header: bool = True, encoding: str = "UTF-8", multiline: bool = True) -> DataFrame:
    """Delimited text; a byte-order mark is dropped, quoted line ends are kept."""
    return spark.read.schema(schema).options(header=header, sep=sep, encoding=encoding, multiLine=multiline, escape='"').csv(path)


def tsv(spark: SparkSession, path: str, schema: str = RATINGS, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated without header; only the named columns are parsed."""
    out = csv(spark, path, schema, sep="\t", header=False, multiline=False)
    return out.select(*columns) if columns else out


def pipe(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return csv(spark, path, schema, sep="|", header=False, encoding="ISO-8859-1", multiline=False)


def tables(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Several CSV files of a folder, each also a temp view."""
    out = {}
    for name, schema in schemas.items():
        out[name] = csv(spark, f"{folder}/{name}.csv", schema)
        out[name].createOrReplaceTempView(name)
    return out


def csv_or_default(spark: SparkSession, path: str, schema: str, rows: list[tuple]) -> DataFrame:
    """The file, or given rows where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return csv(spark, path, schema)
    except AnalysisException:
        return spark.createDataFrame(rows, schema)


def word_vectors(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(token, vector) of a word2vec text file; its first line, with the counts, is skipped."""
    rows = spark.read.text(path).select(F.split("value", " ").alias("p")).filter(F.size("p") > 2)
    rows = rows.select(F.get("p", F.lit(0)).alias("token"), F.transform(F.slice("p", 2, 1 << 20), lambda x: x.cast("float")).alias("vector"))
    return rows.limit(limit) if limit else rows


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


# The grades of a review, from 2 to 0.
GRADES = {
    "taste": ("맛: 좋음", "맛: 보통", "맛: 부족"),
    "price": ("가격: 만족", "가격: 보통", "가격: 불만"),
    "service": ("응대: 좋음", "응대: 보통", "응대: 나쁨"),
}


def reviews(raw: DataFrame) -> DataFrame:
    """Typed reviews out of raw text columns: cleaning, casts, grades and dates in one projection."""
    from tidemill.functions import clean as c

    def grade(name: str):
        return c.ordinal(F.trim(name), *GRADES[name]).cast("tinyint").alias(name)

    return raw.select(
        "id",
        c.clean_text(F.col("item_name")).alias("item_name"),
        "item_area",
        c.parse_rating(F.col("item_avg_rating")).alias("item_avg_rating"),
        "item_spec_area",
        c.badge_flag(F.col("user_name")).alias("gourmet"),
        c.without_badge(F.col("user_name")).alias("user_name"),
        c.parse_rating(F.col("user_tot_avg_rating")).alias("user_tot_avg_rating"),
        c.digits_to_int(F.col("user_tot_rating_num")).alias("user_tot_rating_num"),
        c.digits_to_int(F.col("user_tot_follow_num")).alias("user_tot_follow_num"),
        c.parse_rating(F.col("user_rating")).alias("user_rating"),
        c.clean_text(c.without_more(F.col("user_query"))).alias("user_query"),
        grade("taste"),
        grade("price"),
        grade("service"),
        c.clean_text(F.col("menu")).alias("menu"),
        c.parse_korean_date(F.col("reviewed_at")).alias("reviewed_at"),
    )


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, message: str = "no valid rows") -> DataFrame:
    """``df``, or an error where it is empty."""
    if df.isEmpty():
        raise ValueError(message)
    return df
