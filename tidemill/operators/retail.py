"""Profit-and-loss analytics over a sales fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.runtime import materialize, table


def sales_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line, with sales, profit and its dimensions. Small dimensions are broadcast by Spark
    where their size allows it; the columns that a query doesn't use are never read."""
    line, orders, part = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    sales = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    joined = (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, F.col("o_custkey") == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == region.r_regionkey)
    )
    return joined.select(
        "o_orderkey", "o_custkey", "l_partkey", "p_brand", "p_type", "p_name", "r_name", "n_name", "c_mktsegment", "l_returnflag",
        "l_quantity", F.col("l_discount").alias("discount"), sales.alias("sales"),
        (sales - F.col("l_quantity") * F.col("p_retailprice")).alias("profit"),
        F.col("o_orderdate").cast("date").alias("order_date"), F.col("l_shipdate").cast("date").alias("ship_date"),
    )


def _loss() -> Column:
    return F.sum(F.when(F.col("profit") < 0, F.col("profit")).otherwise(0.0))


def _gain() -> Column:
    return F.sum(F.when(F.col("profit") >= 0, F.col("profit")).otherwise(0.0))


def _share(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0.0)) * 100, digits)


def kpi(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.sum("sales"), 2).alias("total_sales"),
        F.round(F.sum("profit"), 2).alias("total_profit"),
        F.round(F.sum("profit") / F.nullif(F.sum("sales"), F.lit(0.0)) * 100, 2).alias("margin"),
        F.round(F.avg("discount") * 100, 2).alias("avg_discount"),
    )


def yoy_growth(fact: DataFrame) -> DataFrame:
    """Growth of the yearly counts; the first year has none and is left out."""
    years = fact.groupBy(F.year("order_date").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.orderBy("year"))  # one row a year
    return years.withColumn("growth", F.round((F.col("n") - before).cast("double") / before * 100, 1)).filter("growth IS NOT NULL")


def monthly(fact: DataFrame) -> DataFrame:
    return fact.groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(
        F.round(F.sum("sales"), 2).alias("sales"), F.round(F.sum("profit"), 2).alias("profit"), F.count(F.lit(1)).alias("n")
    )


def split_by(fact: DataFrame, key: Column | str, name: str = "key") -> DataFrame:
    """Profit, loss and gain of each key, in one aggregation."""
    key = F.col(key) if isinstance(key, str) else key
    grouped = fact.groupBy(key.alias(name)).agg(F.round(F.sum("profit"), 2).alias("total"), F.round(_loss(), 2).alias("loss"), F.round(_gain(), 2).alias("gain"))
    return grouped.orderBy("total", name)


def bucket(discount: Column, width: int, count: int) -> Column:
    """Half-open buckets of percent; the last one closed; null outside."""
    percent = F.round(discount * 100, 6)
    number = F.least(F.floor(percent / width), F.lit(count - 1))
    return F.when((percent >= 0) & (percent <= width * count), number).cast("int")


def discount_buckets(fact: DataFrame, width: int = 1, count: int = 11) -> DataFrame:
    """Counts, losses and gains by bucket, empty buckets included."""
    spark = fact.sparkSession
    domain = spark.range(count).select(F.col("id").cast("int").alias("b"))
    found = fact.groupBy(bucket(F.col("discount"), width, count).alias("b")).agg(F.count(F.lit(1)).alias("n"), _loss().alias("loss"), _gain().alias("gain"))
    label = F.concat((F.col("b") * width).cast("string"), F.lit("-"), ((F.col("b") + 1) * width).cast("string"), F.lit("%"))
    return domain.join(found, "b", "left").select(
        label.alias("bucket"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.round(F.coalesce("loss", F.lit(0.0)), 2).alias("loss"),
        F.round(F.coalesce("gain", F.lit(0.0)), 2).alias("gain"),
    )


def headline(fact: DataFrame, threshold: float = 0.04) -> DataFrame:
    """Shares of transactions, gains and losses above a discount; gains are strictly positive here."""
    high = F.round(F.col("discount"), 6) > threshold
    gain = F.when(F.col("profit") > 0, F.col("profit")).otherwise(0.0)
    loss = F.when(F.col("profit") < 0, F.col("profit")).otherwise(0.0)
    return fact.agg(
        _share(F.sum(F.when(high, 1.0).otherwise(0.0)), F.count(F.lit(1)).cast("double")).alias("txn_share"),
        _share(F.sum(F.when(high, gain).otherwise(0.0)), F.sum(gain)).alias("gain_share"),
        _share(F.sum(F.when(high, loss).otherwise(0.0)), F.sum(loss)).alias("loss_share"),
    )


def prefix_profit(fact: DataFrame, condition: Column, name: str = "p_name") -> DataFrame:
    first = F.get(F.split(name, " "), F.lit(0)).alias("maker")
    return fact.filter(condition).groupBy(first).agg(F.round(F.sum("profit"), 2).alias("profit")).orderBy("profit", "maker")


def distribution(df: DataFrame, key: Column | str, name: str) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)


def correlation(fact: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's r; null where a column doesn't vary."""
    varies = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    parts = fact.agg(
        varies.alias("varies"), F.covar_pop(a, b).alias("cov"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb")
    )
    return parts.select(F.when(F.col("varies"), F.round(F.col("cov") / F.nullif(F.col("sa") * F.col("sb"), F.lit(0.0)), 3)).alias("r"))


def dashboard(fact: DataFrame) -> DataFrame:
    """All sections as one JSON document: one row, column ``document``. Sections hold bounded numbers of groups; the fact
    is joined once and read again by each of them."""
    columns = ["p_brand", "r_name", "n_name", "p_name", "l_returnflag", "discount", "sales", "profit", "order_date", "ship_date"]
    fact = materialize(fact.select(*columns), "fact")

    def section(df: DataFrame, name: str, order: list[Column | str]) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), F.struct(*df.columns).alias("row"))))
        return df.agg(F.transform(rows, lambda x: x["row"]).alias(name))

    growth = section(yoy_growth(fact).select("year", "growth"), "growth", ["year"])
    one = kpi(fact).join(F.broadcast(correlation(fact, "discount", "profit"))).join(F.broadcast(growth)).join(F.broadcast(headline(fact).select(F.struct("*").alias("headline"))))
    numbers = F.struct(
        F.col("total_sales"), F.col("total_profit"), F.col("margin").alias("margin_pct"), F.col("avg_discount").alias("avg_discount_pct"),
        F.col("n_rows").alias("n_transactions"), F.col("growth").alias("yoy_transaction_growth_pct"), F.col("r").alias("discount_profit_correlation"),
    )
    one = one.select(F.struct(F.col("n_rows").alias("n_transactions")).alias("meta"), numbers.alias("kpi"), "headline")
    parts = [
        section(monthly(fact), "monthly_series", ["month"]),
        section(split_by(fact, "p_brand"), "by_sub_category", ["total", "key"]),
        section(split_by(fact, "r_name"), "by_market_area", ["total", "key"]),
        section(split_by(fact, "n_name"), "by_order_region", ["total", "key"]),
        section(discount_buckets(fact), "discount_buckets", [F.split_part("bucket", F.lit("-"), F.lit(1)).cast("int")]),
        section(prefix_profit(fact, F.col("p_brand") == "Brand#11"), "tables_by_manufacturer", ["profit", "maker"]),
        section(distribution(fact, "l_returnflag", "mode"), "ship_mode_dist", [-F.col("n"), F.col("mode")]),
        section(distribution(fact, eta_bucket(), "eta"), "eta_dist", ["eta"]),
    ]
    for part in parts:
        one = one.join(F.broadcast(part))  # one row each
    order = ["meta", "kpi", "monthly_series", "by_sub_category", "by_market_area", "by_order_region", "discount_buckets", "headline"]
    order += ["tables_by_manufacturer", "ship_mode_dist", "eta_dist"]
    return one.select(F.to_json(F.struct(*order), {"pretty": "true"}).alias("document"))


#: What ``dashboard_rows`` reads of the document: section, key and the numbers of its rows.
DASHBOARD = """STRUCT<meta: STRUCT<n_transactions: BIGINT>, kpi: STRUCT<total_sales: DOUBLE, total_profit: DOUBLE, margin_pct: DOUBLE,
  avg_discount_pct: DOUBLE, n_transactions: BIGINT, yoy_transaction_growth_pct: ARRAY<STRUCT<year: BIGINT, growth: DOUBLE>>,
  discount_profit_correlation: DOUBLE>, headline: STRUCT<txn_share: DOUBLE, gain_share: DOUBLE, loss_share: DOUBLE>,
  monthly_series: ARRAY<STRUCT<month: STRING, sales: DOUBLE, profit: DOUBLE, n: BIGINT>>,
  by_sub_category: ARRAY<STRUCT<key: STRING, total: DOUBLE, loss: DOUBLE, gain: DOUBLE>>,
  by_market_area: ARRAY<STRUCT<key: STRING, total: DOUBLE, loss: DOUBLE, gain: DOUBLE>>,
  by_order_region: ARRAY<STRUCT<key: STRING, total: DOUBLE, loss: DOUBLE, gain: DOUBLE>>,
  discount_buckets: ARRAY<STRUCT<bucket: STRING, n: BIGINT, loss: DOUBLE, gain: DOUBLE>>,
  tables_by_manufacturer: ARRAY<STRUCT<maker: STRING, profit: DOUBLE>>, ship_mode_dist: ARRAY<STRUCT<mode: STRING, n: BIGINT>>,
  eta_dist: ARRAY<STRUCT<eta: BIGINT, n: BIGINT>>>"""


def dashboard_rows(document: DataFrame) -> DataFrame:
    """(section, key, a, b, c): the numbers of a dashboard document, read back from its text."""
    read = document.select(F.from_json("document", DASHBOARD).alias("d"))
    none = F.lit(None).cast("double")

    def row(section: str, key: Column, *numbers: Column) -> Column:
        values = [x.cast("double") for x in numbers] + [none] * (3 - len(numbers))
        return F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"), *[v.alias(n) for v, n in zip(values, "abc", strict=True)])

    def rows(section: str, key: str, *numbers: str) -> Column:
        return F.transform(F.col(f"d.{section}"), lambda x: row(section, x[key], *[x[n] for n in numbers]))

    kpi_names = ["total_sales", "total_profit", "margin_pct", "avg_discount_pct", "n_transactions", "discount_profit_correlation"]
    single = F.array(row("meta", F.lit("n_transactions"), F.col("d.meta.n_transactions")), *[row("kpi", F.lit(n), F.col(f"d.kpi.{n}")) for n in kpi_names],
        *[row("headline", F.lit(n), F.col(f"d.headline.{n}")) for n in ("txn_share", "gain_share", "loss_share")])
    growth = F.transform(F.col("d.kpi.yoy_transaction_growth_pct"), lambda x: row("growth", x["year"], x["growth"]))
    every = F.concat(
        single, growth, rows("monthly_series", "month", "sales", "profit", "n"), rows("by_sub_category", "key", "total", "loss", "gain"),
        rows("by_market_area", "key", "total", "loss", "gain"), rows("by_order_region", "key", "total", "loss", "gain"),
        rows("discount_buckets", "bucket", "n", "loss", "gain"), rows("tables_by_manufacturer", "maker", "profit"),
        rows("ship_mode_dist", "mode", "n"), rows("eta_dist", "eta", "n"),
    )
    return read.select(F.explode(every).alias("x")).select("x.*")


def eta_bucket(days: int = 365) -> Column:
    """Years between order and shipping, as the test tables' dates are far apart."""
    return F.floor(F.datediff("ship_date", "order_date") / F.lit(days)).cast("bigint")


def vertical_split(flat: DataFrame, key: str, parts: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Projections of a flat table that share its key."""
    return {name: flat.select(key, *columns) for name, columns in parts.items()}


def reassemble(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """The flat table again, by one-to-one joins."""
    frames = list(parts.values())
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, key)
    return out


def union_regions(tables: dict[str, DataFrame], name: str = "region") -> DataFrame:
    """UNION ALL of equally shaped tables with their name as a literal column."""
    out = None
    for label, frame in tables.items():
        part = frame.withColumn(name, F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def unique_violations(df: DataFrame, *key: str) -> DataFrame:
    """Keys held by several rows: what a PRIMARY KEY would refuse."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
