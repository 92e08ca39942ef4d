"""Writers: CSV, tables, JDBC batches, JSON documents, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.positions import with_position


def csv(df: DataFrame, path: str, index_by: list[str] | None = None) -> None:
    """CSV with header; ``index_by`` puts a gapless row number in that order first."""
    if index_by:
        df = with_position(df, *index_by, name="index")
        df = df.select("index", *[c for c in df.columns if c != "index"])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", comments: dict[str, str] | None = None) -> None:
    """CREATE TABLE AS SELECT; overwriting makes reruns idempotent."""
    for column, text in (comments or {}).items():
        df = df.withMetadata(column, {"comment": text})
    df.write.mode(mode).saveAsTable(name)


def insert_select(df: DataFrame, name: str) -> None:
    spark = df.sparkSession
    df.select(*spark.table(name).columns).write.insertInto(name)


def insert_values(spark: SparkSession, name: str, rows: list[tuple]) -> None:
    """INSERT INTO ... VALUES: literal rows in the table's column order."""
    spark.createDataFrame(rows, spark.table(name).schema).write.insertInto(name)


def jdbc(df: DataFrame, url: str, name: str, batch: int = 1000, **options: str) -> None:
    """Batched inserts, one commit for each partition."""
    df.write.format("jdbc").options(url=url, dbtable=name, batchsize=str(batch), **options).mode("append").save()


def json_document(df: DataFrame, path: str) -> None:
    """The one-row document column as UTF-8 text."""
    df.select("document").coalesce(1).write.mode("overwrite").text(path)


def drop_tables(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def log_run(spark: SparkSession, path: str, run: str, params: dict[str, str], metrics: dict[str, float]) -> None:
    """Append a row of parameters and metrics to the runs table."""
    schema = "run string, params map<string,string>, metrics map<string,double>"
    spark.createDataFrame([(run, params, metrics)], schema).write.mode("append").parquet(path)


def compare_runs(runs: DataFrame, params: list[str], metrics: list[str], by: str) -> DataFrame:
    """Runs with maps flattened to columns, best first."""
    flat = runs.select("run", *[F.try_element_at("params", F.lit(p)).alias(p) for p in params], *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics])
    return flat.orderBy(F.asc_nulls_last(by), "run")
