"""All queries of the library by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import clean
from tidemill.operators import positions, recommend, retail, schedule, textops
from tidemill.runtime import materialize, table
from tidemill.sources import sinks
from tidemill.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql.strip()
        return function

    return add


# --- retail ------------------------------------------------------------------------------------------------------------
FACT = """WITH fact AS (
  SELECT o_orderkey, o_custkey, l_partkey, p_brand, p_type, p_name, r_name, n_name, c_mktsegment, l_returnflag, l_quantity,
    l_discount AS discount, l_extendedprice * (1 - l_discount) AS sales,
    l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice AS profit,
    CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS ship_date
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
SPLIT = FACT + """SELECT {0} AS key, round(sum(profit), 2) AS total,
  round(sum(CASE WHEN profit < 0 THEN profit ELSE 0.0 END), 2) AS loss,
  round(sum(CASE WHEN profit >= 0 THEN profit ELSE 0.0 END), 2) AS gain FROM fact GROUP BY {0}"""


@query(FACT + """SELECT count(*) AS n_rows, round(sum(sales), 2) AS total_sales, round(sum(profit), 2) AS total_profit,
  round(sum(profit) / nullif(sum(sales), 0) * 100, 2) AS margin, round(avg(discount) * 100, 2) AS avg_discount FROM fact""")
def kpi_summary(spark, sf_dir):
    return retail.kpi(retail.sales_fact(spark, sf_dir))


@query(FACT + """, y AS (SELECT CAST(year(order_date) AS BIGINT) AS year, count(*) AS n FROM fact GROUP BY 1),
  g AS (SELECT year, n, lag(n) OVER (ORDER BY year) AS b FROM y)
  SELECT year, n, round((n - b)::DOUBLE / b * 100, 1) AS growth FROM g WHERE b IS NOT NULL""")
def yoy_growth(spark, sf_dir):
    return retail.yoy_growth(retail.sales_fact(spark, sf_dir))


@query(FACT + """SELECT strftime(order_date, '%Y-%m') AS month, round(sum(sales), 2) AS sales, round(sum(profit), 2) AS profit,
  count(*) AS n FROM fact GROUP BY 1""")
def monthly_series(spark, sf_dir):
    return retail.monthly(retail.sales_fact(spark, sf_dir))


@query(SPLIT.format("p_brand"))
def split_by_brand(spark, sf_dir):
    return retail.split_by(retail.sales_fact(spark, sf_dir), "p_brand")


@query(SPLIT.format("r_name"))
def split_by_region(spark, sf_dir):
    return retail.split_by(retail.sales_fact(spark, sf_dir), "r_name")


@query(SPLIT.format("n_name"))
def split_by_nation(spark, sf_dir):
    return retail.split_by(retail.sales_fact(spark, sf_dir), "n_name")


@query(FACT + """, b AS (SELECT CAST(least(floor(round(discount * 100, 6) / 1), 10) AS INT) AS b, count(*) AS n,
    sum(CASE WHEN profit < 0 THEN profit ELSE 0.0 END) AS loss, sum(CASE WHEN profit >= 0 THEN profit ELSE 0.0 END) AS gain
    FROM fact WHERE round(discount * 100, 6) BETWEEN 0 AND 11 GROUP BY 1)
  SELECT concat(d.i, '-', d.i + 1, '%') AS bucket, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(loss, 0.0), 2) AS loss,
    round(coalesce(gain, 0.0), 2) AS gain FROM range(11) d(i) LEFT JOIN b ON b.b = d.i""")
def discount_buckets(spark, sf_dir):
    return retail.discount_buckets(retail.sales_fact(spark, sf_dir))


@query(FACT + """SELECT round(sum(CASE WHEN round(discount, 6) > 0.04 THEN 1.0::DOUBLE ELSE 0 END) / count(*) * 100, 1) AS txn_share,
  round(sum(CASE WHEN round(discount, 6) > 0.04 AND profit > 0 THEN profit ELSE 0.0 END) / nullif(sum(CASE WHEN profit > 0 THEN profit ELSE 0.0 END), 0) * 100, 1) AS gain_share,
  round(sum(CASE WHEN round(discount, 6) > 0.04 AND profit < 0 THEN profit ELSE 0.0 END) / nullif(sum(CASE WHEN profit < 0 THEN profit ELSE 0.0 END), 0) * 100, 1) AS loss_share
  FROM fact""")
def headline_shares(spark, sf_dir):
    return retail.headline(retail.sales_fact(spark, sf_dir))


@query(FACT + """SELECT split_part(p_name, ' ', 1) AS maker, round(sum(profit), 2) AS profit FROM fact WHERE p_brand = 'Brand#11' GROUP BY 1""")
def prefix_profit(spark, sf_dir):
    return retail.prefix_profit(retail.sales_fact(spark, sf_dir), F.col("p_brand") == "Brand#11")


@query(FACT + "SELECT l_returnflag AS mode, count(*) AS n FROM fact GROUP BY 1")
def mode_distribution(spark, sf_dir):
    return retail.distribution(retail.sales_fact(spark, sf_dir), "l_returnflag", "mode")


@query(FACT + "SELECT CAST(floor(date_diff('day', order_date, ship_date) / 365.0) AS BIGINT) AS eta, count(*) AS n FROM fact GROUP BY 1")
def eta_distribution(spark, sf_dir):
    return retail.distribution(retail.sales_fact(spark, sf_dir), retail.eta_bucket(), "eta")


@query(FACT + "SELECT round(corr(discount, profit), 3) AS r FROM fact")
def discount_profit_corr(spark, sf_dir):
    return retail.correlation(retail.sales_fact(spark, sf_dir), "discount", "profit")


@query()
def dashboard_json(spark, sf_dir):
    return retail.dashboard(retail.sales_fact(spark, sf_dir))


def _section(name: str, key: str, numbers: str, source: str) -> str:
    padded = (numbers.split(", ") + ["NULL", "NULL"])[:3]
    columns = ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for x, n in zip(padded, "abc", strict=True))
    return f"SELECT '{name}' AS section, CAST({key} AS VARCHAR) AS key, {columns} FROM ({source})"


def _inner(name: str) -> str:
    """The SQL of a query without the common part."""
    return ORACLES[name].removeprefix(FACT.strip()).strip()


def _dashboard_sql() -> str:
    single = [_section("meta", "'n_transactions'", "n_rows", _inner("kpi_summary"))]
    for name, column in (("total_sales",) * 2, ("total_profit",) * 2, ("margin_pct", "margin"), ("avg_discount_pct", "avg_discount"), ("n_transactions", "n_rows")):
        single.append(_section("kpi", f"'{name}'", column, _inner("kpi_summary")))
    single.append(_section("kpi", "'discount_profit_correlation'", "r", _inner("discount_profit_corr")))
    single += [_section("headline", f"'{n}'", n, _inner("headline_shares")) for n in ("txn_share", "gain_share", "loss_share")]
    growth = "SELECT year, round((n - b)::DOUBLE / b * 100, 1) AS growth FROM (SELECT year, n, lag(n) OVER (ORDER BY year) AS b FROM (SELECT year(order_date) AS year, count(*) AS n FROM fact GROUP BY 1)) WHERE b IS NOT NULL"
    buckets = "WITH " + _inner("discount_buckets").removeprefix(",").strip()
    parts = [
        *single, _section("growth", "year", "growth", growth), _section("monthly_series", "month", "sales, profit, n", _inner("monthly_series")),
        _section("by_sub_category", "key", "total, loss, gain", _inner("split_by_brand")), _section("by_market_area", "key", "total, loss, gain", _inner("split_by_region")),
        _section("by_order_region", "key", "total, loss, gain", _inner("split_by_nation")), _section("discount_buckets", "bucket", "n, loss, gain", buckets),
        _section("tables_by_manufacturer", "maker", "profit", _inner("prefix_profit")), _section("ship_mode_dist", "mode", "n", _inner("mode_distribution")),
        _section("eta_dist", "eta", "n", _inner("eta_distribution")),
    ]
    return FACT.replace("fact AS (", "fact AS MATERIALIZED (") + " UNION ALL ".join(parts)


@query(_dashboard_sql())
def dashboard_sections(spark, sf_dir):
    """Every number of the dashboard document, read back from its text."""
    return retail.dashboard_rows(retail.dashboard(retail.sales_fact(spark, sf_dir)))


# --- reshaping ---------------------------------------------------------------------------------------------------------
FLAT = """SELECT o_orderkey AS row_id, o_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, o_orderstatus AS status,
  CAST(o_orderdate AS DATE) AS order_date, o_totalprice AS sales, n_name AS country, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
PARTS = {
    "customer": ["customer_id", "customer_name", "segment"],
    "orders": ["status", "order_date", "sales"],
    "market": ["country"],
    "shipping": ["priority"],
}


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == nation.n_nationkey)
    return joined.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").alias("sales"), F.col("n_name").alias("country"), F.col("o_orderpriority").alias("priority"),
    )


@query(f"SELECT row_id, customer_id, customer_name, segment FROM ({FLAT})")
def vertical_split(spark, sf_dir):
    return retail.vertical_split(_flat(spark, sf_dir), "row_id", PARTS)["customer"]


@query(FLAT)
def reassembled(spark, sf_dir):
    return retail.reassemble(retail.vertical_split(_flat(spark, sf_dir), "row_id", PARTS), "row_id")


def _regions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = [r[0] for r in region.select("r_name").orderBy("r_name").collect()]  # five rows
    return {n: nation.join(F.broadcast(region.filter(F.col("r_name") == n)), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name") for n in names}


@query("SELECT n_nationkey, n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def union_regions(spark, sf_dir):
    return retail.union_regions(_regions(spark, sf_dir))


@query("SELECT n_nationkey, n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def exec_dynamic_union(spark, sf_dir):
    """The same by generated SQL text, run with EXECUTE IMMEDIATE."""
    parts = []
    for i, (name, frame) in enumerate(_regions(spark, sf_dir).items()):
        frame.createOrReplaceTempView(f"nation_part_{i}")
        parts.append(f"SELECT n_nationkey, n_name, ''{name}'' AS region FROM nation_part_{i}")
    return spark.sql(f"EXECUTE IMMEDIATE '{' UNION ALL '.join(parts)}'")


@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\r\\n|\\r|\\n', ' ', 'g'), ' ') AS clean FROM documents")
def text_cleaned(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean.clean_text(F.col("text")).alias("clean"))


@query("""SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 0 ELSE NULL END AS DOUBLE) AS code
  FROM orders""")
def ordinal_case(spark, sf_dir):
    code = clean.ordinal(F.col("o_orderpriority"), "1-URGENT", "2-HIGH", "3-MEDIUM").cast("double").alias("code")
    return table(spark, sf_dir, "orders").select("o_orderkey", code)


@query("""SELECT p_partkey, TRY_CAST(nullif(regexp_replace(CASE WHEN p_size % 7 = 0 THEN 'nan' ELSE concat(p_size / 10.0::DOUBLE, '점') END, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS rating
  FROM part""")
def rating_parse(spark, sf_dir):
    raw = F.when(F.col("p_size") % 7 == 0, "nan").otherwise(F.concat((F.col("p_size") / 10.0).cast("string"), F.lit("점")))
    return table(spark, sf_dir, "part").select("p_partkey", clean.parse_rating(raw).alias("rating"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS reviewed_at FROM orders")
def kdate_parse(spark, sf_dir):
    raw = F.date_format("o_orderdate", "yyyy년 M월 d일")
    return table(spark, sf_dir, "orders").select("o_orderkey", clean.parse_korean_date(raw).alias("reviewed_at"))


@query("SELECT p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)")
def label_encode(spark, sf_dir):
    return positions.label_encode(table(spark, sf_dir, "part"), "p_name")


@query("SELECT DISTINCT text, lang FROM documents")
def dedup_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("text", "lang").dropDuplicates()


@query("SELECT count(*) AS n_repeated, coalesce(sum(n), 0)::BIGINT AS n_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def repeated_groups(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("n_repeated"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


@query("SELECT event_id, user_id AS \"user\", event_type AS item FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 60)")
def multi_interaction_users(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("user"), F.col("event_type").alias("item"))
    return recommend.frequent_users(rows, 60)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return retail.unique_violations(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


# --- recommender preparation -----------------------------------------------------------------------------------------
UI = """WITH ui AS MATERIALIZED (SELECT o_custkey AS "user", l_partkey AS item, sum(l_quantity) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
SPLITS = UI + """, placed AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY md5(concat_ws('-', "user", item)), item) AS place,
    count(*) OVER (PARTITION BY "user") AS n FROM ui),
  split AS MATERIALIZED (SELECT "user", item, rating, CASE WHEN place <= round_even(n * 0.8, 0) THEN 'train' ELSE 'test' END AS split FROM placed),
  train AS MATERIALIZED (SELECT "user", item, rating FROM split WHERE split = 'train'), test AS MATERIALIZED (SELECT "user", item, rating FROM split WHERE split = 'test')"""
BIAS = SPLITS + """, mu AS (SELECT avg(rating) AS mu FROM train), u AS (SELECT "user", avg(rating) AS u FROM train GROUP BY 1),
  i AS (SELECT item, avg(rating) AS i FROM train GROUP BY 1),
  predicted AS (SELECT "user", item, rating AS actual, round(mu + coalesce(u - mu, 0) + coalesce(i - mu, 0), 6) AS pred
    FROM test LEFT JOIN u USING ("user") LEFT JOIN i USING (item) CROSS JOIN mu)"""


def _ui(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.interactions(spark, sf_dir)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = materialize(positions.holdout(_ui(spark, sf_dir)), "holdout")
    return rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split")


@query(UI + """SELECT count(*) AS pairs, count(DISTINCT "user") AS users, count(DISTINCT item) AS items,
  round(1 - count(*) / (count(DISTINCT "user")::DOUBLE * count(DISTINCT item)), 6) AS sparsity FROM ui""")
def sparsity(spark, sf_dir):
    return recommend.sparsity(_ui(spark, sf_dir))


@query(SPLITS + 'SELECT "user", item, rating, split FROM split')
def holdout_hash(spark, sf_dir):
    return positions.holdout(_ui(spark, sf_dir))


@query(UI + """SELECT "user", item, rating, place FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY item) AS place FROM ui) WHERE place BETWEEN 3 AND 7""")
def holdout_nth(spark, sf_dir):
    return positions.nth_of_user(_ui(spark, sf_dir), 3, 7).withColumn("place", F.col("place").cast("bigint"))


@query(UI + 'SELECT "user", item, rating, ntile(5) OVER (ORDER BY "user", item) AS fold FROM ui')
def folds_ntile(spark, sf_dir):
    return positions.folds(_ui(spark, sf_dir), 5, "user", "item")


@query(SPLITS + 'SELECT * FROM ui WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t."user" = ui."user" AND t.item = ui.item)')
def anti_train_test(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    rows = train.unionByName(test)
    return rows.join(train.select("user", "item"), ["user", "item"], "left_anti").select("user", "item", "rating")


@query(SPLITS + 'SELECT * FROM test WHERE "user" IN (SELECT "user" FROM train) AND item IN (SELECT item FROM train)')
def cold_start_filter(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return recommend.known_pairs(test, train).select("user", "item", "rating")


@query(UI + "SELECT round(avg(m), 6) AS macro_mean FROM (SELECT avg(rating) AS m FROM ui GROUP BY item)")
def macro_mean(spark, sf_dir):
    return recommend.macro_mean(_ui(spark, sf_dir))


@query("""SELECT o_custkey AS "user", coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0) AS "A",
  coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0) AS "N", coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS "R"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def pivot_quantity(spark, sf_dir):
    fact = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return fact.groupBy(F.col("o_custkey").alias("user")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).fillna(0.0)


COSINE = UI + """, norms AS (SELECT {0} AS e, sqrt(sum(rating * rating)) AS norm FROM ui GROUP BY 1),
  pairs AS (SELECT x.{0} AS a, y.{0} AS b, sum(x.rating * y.rating) AS dot, count(*) AS shared FROM ui x JOIN ui y ON x.{1} = y.{1} AND x.{0} < y.{0}
    GROUP BY 1, 2),
  sims AS (SELECT a, b, shared, round(dot / nullif(na.norm * nb.norm, 0), 6) AS sim FROM pairs JOIN norms na ON na.e = a JOIN norms nb ON nb.e = b),
  both_ways AS (SELECT a, b, sim FROM sims UNION ALL SELECT b, a, sim FROM sims)"""
ITEMS, USERS = COSINE.format("item", '"user"'), COSINE.format('"user"', "item")


@query(ITEMS + "SELECT * FROM sims")
def item_cosine(spark, sf_dir):
    return recommend.cosine(_ui(spark, sf_dir), "item", "user")


@query(USERS + "SELECT * FROM sims")
def user_cosine(spark, sf_dir):
    return recommend.cosine(_ui(spark, sf_dir), "user", "item")


@query(ITEMS + """SELECT ui."user", ui.item, round(coalesce(sum(sim * o.rating) / nullif(sum(sim), 0), 0), 6) AS pred
  FROM ui JOIN both_ways ON a = ui.item JOIN ui o ON o."user" = ui."user" AND o.item = b GROUP BY 1, 2""")
def item_cf_predict(spark, sf_dir):
    return recommend.item_cf(_ui(spark, sf_dir))


@query(USERS + """, means AS (SELECT "user", avg(rating) AS mean FROM ui GROUP BY 1)
  SELECT ui."user", ui.item, round(any_value(m.mean) + coalesce(sum(sim * (o.rating - om.mean)) / nullif(sum(abs(sim)), 0), 0), 6) AS pred
  FROM ui JOIN both_ways ON a = ui."user" JOIN ui o ON o."user" = b AND o.item = ui.item JOIN means om ON om."user" = b JOIN means m ON m."user" = ui."user" GROUP BY 1, 2""")
def user_cf_predict(spark, sf_dir):
    return recommend.user_cf(_ui(spark, sf_dir))


@query(ITEMS + """SELECT a, b, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM both_ways) WHERE rank <= 3""")
def item_neighbours(spark, sf_dir):
    return recommend.sharing.nearest(_ui(spark, sf_dir), "item", "user", 3)


@query(BIAS + "SELECT * FROM predicted")
def bias_baseline(spark, sf_dir):
    return recommend.bias_baseline(*_split(spark, sf_dir))


@query(BIAS + """SELECT "user", item, actual, pred, rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY pred DESC, item) AS rank FROM predicted) WHERE rank <= 3""")
def top_k_per_user(spark, sf_dir):
    return recommend.top_k(recommend.bias_baseline(*_split(spark, sf_dir)), 3)


METRICS = BIAS + """, ranked AS (SELECT *, pow(2, actual / 50.0::DOUBLE) - 1 AS gain, row_number() OVER (PARTITION BY "user" ORDER BY pred DESC, item) AS p,
    row_number() OVER (PARTITION BY "user" ORDER BY actual DESC, item) AS a FROM predicted),
  per_user AS (SELECT "user", count(*) AS n, sum((p <= 3)::INT)::DOUBLE AS hits, sum((p <= 3 AND a <= 3)::INT)::DOUBLE AS both_top,
    sum(CASE WHEN p <= 3 THEN gain / log2(p + 1) ELSE 0 END) AS dcg, sum(CASE WHEN a <= 3 THEN gain / log2(a + 1) ELSE 0 END) AS ideal FROM ranked GROUP BY 1)"""


@query(METRICS + """SELECT round(avg(hits / 3), 6) AS precision_at_k, round(avg(hits / n), 6) AS recall_at_k, round(avg(both_top / 3), 6) AS hit_rate_at_k,
  round(avg(coalesce(dcg / nullif(ideal, 0), 0)), 6) AS ndcg_at_k FROM per_user""")
def precision_recall_ndcg(spark, sf_dir):
    return recommend.ranking_metrics(recommend.bias_baseline(*_split(spark, sf_dir)))


@query(METRICS + "SELECT round(avg(both_top / 3), 6) AS hit_rate_at_k FROM per_user")
def hit_rate(spark, sf_dir):
    return recommend.ranking_metrics(recommend.bias_baseline(*_split(spark, sf_dir))).select("hit_rate_at_k")


@query(BIAS + """, m AS (SELECT *, (actual > avg(actual) OVER (PARTITION BY "user"))::INT::DOUBLE AS relevant,
    row_number() OVER (PARTITION BY "user" ORDER BY pred DESC, item) AS p FROM predicted),
  pu AS (SELECT "user", sum(CASE WHEN p <= 3 THEN relevant ELSE 0 END) AS hits, sum(relevant) AS n FROM m GROUP BY 1)
  SELECT round(avg(hits / 3), 6) AS precision_at_k, round(avg(coalesce(hits / nullif(n, 0), 0)), 6) AS recall_at_k FROM pu""")
def above_mean_metrics(spark, sf_dir):
    return recommend.above_mean_metrics(recommend.bias_baseline(*_split(spark, sf_dir)))


@query(UI + """, f AS (SELECT *, ntile(5) OVER (ORDER BY "user", item) AS fold FROM ui), k AS (SELECT i AS fold FROM range(1, 6) r(i)),
  mu AS (SELECT k.fold, avg(rating) AS mu FROM k JOIN f ON f.fold <> k.fold GROUP BY 1),
  i AS (SELECT k.fold, item, avg(rating) AS i FROM k JOIN f ON f.fold <> k.fold GROUP BY 1, 2)
  SELECT f.fold, round(sqrt(avg(pow(coalesce(i, mu) - rating, 2))), 6) AS rmse FROM f JOIN mu USING (fold) LEFT JOIN i ON i.fold = f.fold AND i.item = f.item GROUP BY 1""")
def rmse_by_fold(spark, sf_dir):
    """Item means of the other folds as predictions, from sums by item and fold: each fold's are the total less its own."""
    rows = materialize(positions.folds(_ui(spark, sf_dir), 5, "user", "item"), "folds")
    sums = rows.groupBy("item", "fold").agg(F.sum("rating").alias("s"), F.count(F.lit(1)).alias("n"))
    item = sums.groupBy("item").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    own = sums.groupBy("fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    total = sums.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    mu = own.join(F.broadcast(total)).select("fold", ((F.col("ts") - F.col("fs")) / F.nullif(F.col("tn") - F.col("fn"), F.lit(0))).alias("mu"))
    means = sums.join(item, "item").select("item", "fold", ((F.col("all_s") - F.col("s")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))).alias("i"))
    joined = rows.join(means, ["item", "fold"]).join(F.broadcast(mu), "fold")
    return recommend.rmse(joined.select("fold", F.col("rating").alias("actual"), F.coalesce("i", "mu").alias("pred")), "fold")


@query()
def mf_als(spark, sf_dir):
    return recommend.als_predict(*_split(spark, sf_dir))


@query()
def svd_reconstruct(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    out = recommend.svd(rows, "vec_id", "embedding", 8)
    error = F.zip_with("embedding", "approximation", lambda x, y: x - y)
    return out.select("vec_id", F.round(F.sqrt(clean.dot(error, error)), 6).alias("error"))


FACTORS = [[((i * 7 + f * 3) % 11 - 5) / 10 for f in range(4)] for i in range(64)]


@query(f"""WITH v(i, f, w) AS (SELECT i + 1, f, ((i * 7 + f * 3) % 11 - 5) / 10.0::DOUBLE FROM range(64) a(i), range(4) b(f)),
  z AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  t AS (SELECT vec_id, f, pow(sum(x * w), 2) - sum(x * x * w * w) AS t FROM z JOIN v USING (i) GROUP BY 1, 2)
  SELECT vec_id, round(sum(t) * 0.5, 5) AS fm FROM t GROUP BY 1""")
def fm_term(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(recommend.fm_term(F.col("embedding"), FACTORS), 5).alias("fm"))


@query("""WITH c AS (SELECT label, avg(x) AS m, i FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 3),
  z AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
  SELECT vec_id, round(sum(x * m) / nullif(sqrt(sum(x * x)) * sqrt(sum(m * m)), 0), 5) AS cosine FROM z JOIN c USING (label, i) GROUP BY 1""")
def embedding_cosine(spark, sf_dir):
    """Cosine of each vector with the mean vector of its label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    cells = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    size = F.sqrt(clean.dot("v", "v")) * F.sqrt(clean.dot("c", "c"))
    return rows.join(centre, "label").select("vec_id", F.round(clean.dot("v", "c") / F.nullif(size, F.lit(0.0)), 5).alias("cosine"))


# --- text --------------------------------------------------------------------------------------------------------------
TURNS = """WITH turns AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a
  JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
  pairs AS (SELECT conv_id * 1000 + turn AS id, question, answer FROM turns)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn; repeated copies of a conversation's turns stay."""
    turns = table(spark, sf_dir, "conversations")
    ask = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return ask.join(reply, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "question", "answer")


@query("SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn, coalesce(text, '')) AS doc FROM conversations GROUP BY 1")
def doc_concat(spark, sf_dir):
    return textops.doc_concat(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"
VOCAB = f"""WITH t AS (SELECT unnest({TOKENS.format('text')}) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM t GROUP BY 1),
  vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM c ORDER BY n DESC, token LIMIT 200)"""


@query(VOCAB + "SELECT token, n, id FROM vocab")
def vocab_topn(spark, sf_dir):
    return textops.vocabulary(table(spark, sf_dir, "documents"), "text", 200)


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return textops.encode(docs, "doc_id", "text", textops.vocabulary(docs, "text", 200), 550)


@query(VOCAB + f""", w AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {TOKENS.format('text')} AS l FROM documents)),
  e AS (SELECT doc_id, string_agg(coalesce(id, 1)::VARCHAR, ',' ORDER BY i) AS s, count(*) AS k FROM w LEFT JOIN vocab USING (token) WHERE i <= 550 GROUP BY 1)
  SELECT doc_id, concat(coalesce(s, ''), CASE WHEN coalesce(k, 0) < 550 THEN concat(CASE WHEN coalesce(k, 0) > 0 THEN ',' ELSE '' END, '0', repeat(',0', (549 - coalesce(k, 0))::BIGINT)) ELSE '' END) AS seq
  FROM documents LEFT JOIN e USING (doc_id)""")
def padded_seq(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", F.array_join(F.col("seq").cast("array<string>"), ",").alias("seq"))


@query(VOCAB + f""", w AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {TOKENS.format('text')} AS l FROM documents))
  SELECT round(avg((id IS NULL)::INT::DOUBLE), 6) AS unk_ratio FROM w LEFT JOIN vocab USING (token) WHERE i <= 550""")
def unk_ratio(spark, sf_dir):
    return textops.unk_ratio(_encoded(spark, sf_dir))


@query(VOCAB + "SELECT round(avg((id IS NOT NULL)::INT::DOUBLE), 6) AS coverage FROM c LEFT JOIN vocab USING (token)")
def vocab_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return textops.coverage(docs, "text", textops.vocabulary(docs, "text", 200))


@query(TURNS + """SELECT id, concat('<start_of_turn>user', chr(10), question, '<end_of_turn>', chr(10), '<start_of_turn>model', chr(10), answer, '<end_of_turn>') AS prompt
  FROM pairs WHERE question IS NOT NULL AND answer IS NOT NULL""")
def prompt_template(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("id", clean.prompt(F.col("question"), F.col("answer")).alias("prompt"))
    return rows.filter(F.col("prompt").isNotNull())


@query(TURNS + """SELECT id, regexp_replace(CASE WHEN strpos(answer, '<end_of_turn>') > 0 THEN left(answer, strpos(answer, '<end_of_turn>') - 1) ELSE answer END, '^\\s+|\\s+$', '', 'g') AS response
  FROM pairs WHERE question IS NOT NULL AND answer IS NOT NULL""")
def response_extract(spark, sf_dir):
    rows = _pairs(spark, sf_dir).filter(F.col("question").isNotNull() & F.col("answer").isNotNull())
    return rows.select("id", clean.response(clean.prompt(F.col("question"), F.col("answer")), F.col("question")).alias("response"))


GRAMS = TURNS + f""", s AS (SELECT id, {TOKENS.format('answer')} AS c, {TOKENS.format('question')} AS r FROM pairs),
  cg AS (SELECT id, unnest(list_transform(range(1, len(c) - {{0}} + 2), lambda i: array_to_string(c[i:i + {{0}} - 1], ' '))) AS gram FROM s),
  rg AS (SELECT id, unnest(list_transform(range(1, len(r) - {{0}} + 2), lambda i: array_to_string(r[i:i + {{0}} - 1], ' '))) AS gram FROM s),
  cc AS (SELECT id, gram, count(*) AS c FROM cg GROUP BY 1, 2), rc AS (SELECT id, gram, count(*) AS r FROM rg GROUP BY 1, 2),
  o AS (SELECT coalesce(cc.id, rc.id) AS id, sum(coalesce(c, 0)) AS cand, sum(coalesce(r, 0)) AS ref, sum(least(coalesce(c, 0), coalesce(r, 0))) AS hits
    FROM cc FULL JOIN rc ON cc.id = rc.id AND cc.gram = rc.gram GROUP BY 1)"""
ROUGE = GRAMS + """, pr AS (SELECT coalesce(hits::DOUBLE / nullif(cand, 0), 0) AS p, coalesce(hits::DOUBLE / nullif(ref, 0), 0) AS r FROM o)
  SELECT round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) AS f1 FROM pr"""


@query(GRAMS.replace("{0}", "1") + """, t AS (SELECT sum(cand)::DOUBLE AS c, sum(ref)::DOUBLE AS r, sum(hits)::DOUBLE AS h FROM o)
  SELECT round(CASE WHEN c >= r THEN 1.0 ELSE exp(1 - r / nullif(c, 0)) END * h / nullif(c, 0), 6) AS bleu1 FROM t""")
def bleu1(spark, sf_dir):
    return textops.bleu1(_pairs(spark, sf_dir), "id", "answer", "question")


@query(ROUGE.replace("{0}", "1"))
def rouge1(spark, sf_dir):
    return textops.rouge_n(_pairs(spark, sf_dir), "id", "answer", "question", 1)


@query(ROUGE.replace("{0}", "2"))
def rouge2(spark, sf_dir):
    return textops.rouge_n(_pairs(spark, sf_dir), "id", "answer", "question", 2)


@query()
def rouge_l(spark, sf_dir):
    return textops.scored(_pairs(spark, sf_dir), "id", "rouge_l", textops.rouge_l_score, "answer", "question")


SETS = ", ".join(f"list_distinct(list_transform(range(1, len({x}) - n + 2), lambda i: array_to_string({x}[i:i + n - 1], ' '))) AS {x}" for x in "scr")


def _f1(good: str, made: str, wanted: str) -> str:
    p, q = f"coalesce({good}::DOUBLE / nullif({made}, 0), 0)", f"coalesce({good}::DOUBLE / nullif({wanted}, 0), 0)"
    return f"CASE WHEN {made} = 0 AND {wanted} = 0 THEN 1.0 ELSE coalesce(2 * {p} * {q} / nullif({p} + {q}, 0), 0) END"


def _without(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda x: NOT list_contains({b}, x)))"


@query(TURNS + f""", k AS (SELECT row_number() OVER () AS rid, * FROM pairs),
  t AS (SELECT rid, id, {TOKENS.format("concat_ws(' ', question, answer)")} AS s, {TOKENS.format('answer')} AS c, {TOKENS.format('question')} AS r FROM k),
  g AS (SELECT rid, id, n, {SETS} FROM t, range(1, 5) z(n)),
  i AS (SELECT *, list_intersect(s, c) AS sc, list_intersect(s, r) AS sr, list_intersect(c, r) AS cr, list_filter(s, lambda x: NOT list_contains(c, x)) AS gone FROM g),
  m AS (SELECT rid, id, len(list_intersect(sc, r)) AS kg, len(sc) AS km, len(sr) AS kw, {_without('cr', 's')} AS ag, {_without('c', 's')} AS am,
    {_without('r', 's')} AS aw, len(gone) AS dm, {_without('gone', 'r')} AS dg, {_without('s', 'r')} AS dw FROM i),
  f AS (SELECT rid, id, ({_f1('kg', 'km', 'kw')} + {_f1('ag', 'am', 'aw')} + CASE WHEN dm > 0 THEN dg::DOUBLE / dm WHEN dw = 0 THEN 1 ELSE 0 END) / 3 AS x FROM m)
  SELECT id, round(100 * sum(x) / 4, 6) AS sari FROM f GROUP BY rid, id""")
def sari(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("source", F.concat_ws(" ", "question", "answer"))
    return textops.sari(rows, "id", "source", "answer", "question")


@query(r"""WITH parts AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w,
    greatest(1, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda p: regexp_matches(p, '\S')))) AS sentences FROM documents),
  counted AS (SELECT doc_id, len(w) AS n, sentences, list_sum(list_transform(w, lambda x:
    greatest(1, len(regexp_extract_all(x, '[aeiouyáàâäéèêëíìîïóòôöúùûü]+')) - CASE WHEN x LIKE '%e' AND len(regexp_extract_all(x, '[aeiouyáàâäéèêëíìîïóòôöúùûü]+')) > 1 THEN 1 ELSE 0 END))) AS syl FROM parts)
  SELECT doc_id, CASE WHEN n > 0 THEN round(0.39::DOUBLE * n / sentences + 11.8::DOUBLE * syl / n - 15.59::DOUBLE, 6) END AS fkgl FROM counted""")
def fkgl(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textops.fkgl(F.col("text")).alias("fkgl"))


@query("""SELECT page_id, nullif(regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1), '') AS title,
  nullif(regexp_extract(coalesce(html, ''), '<h1[^>]*>([^<]*)</h1>', 1), '') AS heading FROM pages""")
def html_fields(spark, sf_dir):
    return textops.html_fields(table(spark, sf_dir, "pages"), "page_id", "html", {"title": "<title>([^<]*)</title>", "heading": "<h1[^>]*>([^<]*)</h1>"})


@query("SELECT page_id, TRY_CAST(nullif(array_to_string(regexp_extract_all(url, '\\d+'), ''), '') AS BIGINT) AS digits FROM pages")
def url_digits(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean.digits_to_int(F.col("url")).alias("digits"))


@query("""SELECT doc_id, CASE WHEN length(text) > 150 THEN concat(left(text, 150), '...') ELSE text END AS preview FROM documents""")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean.preview(F.col("text")).alias("preview"))


@query("""SELECT * FROM (VALUES ('base', '0.001', 0.7098::DOUBLE), ('deep', '0.0005', 0.5749::DOUBLE), ('plain', NULL, 0.578::DOUBLE)) t(run, rate, rmse)""")
def run_compare(spark, sf_dir):
    rows = [("plain", {}, {"rmse": 0.578}), ("base", {"rate": "0.001"}, {"rmse": 0.7098}), ("deep", {"rate": "0.0005"}, {"rmse": 0.5749})]
    runs = spark.createDataFrame(rows, "run string, params map<string,string>, metrics map<string,double>")
    return sinks.compare_runs(runs, ["rate"], ["rmse"], "rmse")


# --- schedules, streams --------------------------------------------------------------------------------------------------
BUSY = """WITH busy AS (SELECT user_id AS "user", CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS s,
    CAST(hour(ts) * 60 + minute(ts) + 30 AS BIGINT) AS e FROM events),
  inside AS (SELECT "user", day, greatest(s, 660) AS s, least(e, 900) AS e FROM busy WHERE greatest(s, 660) < least(e, 900)),
  edged AS (SELECT * FROM inside UNION ALL SELECT DISTINCT "user", day, 900::BIGINT, 900::BIGINT FROM busy),
  free AS (SELECT "user", day, coalesce(max(e) OVER (PARTITION BY "user", day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 660) AS free_from, s AS free_to FROM edged),
  slots AS (SELECT * FROM free WHERE free_to - free_from >= 30)"""


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("bigint")
    busy = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("ts").cast("date").cast("string").alias("day"), minute.alias("start"), (minute + 30).alias("end"))
    return schedule.free_slots(busy, 660, 900, 30).select("user", "day", F.col("free_from").cast("bigint").alias("free_from"), F.col("free_to").cast("bigint").alias("free_to"))


@query(BUSY + 'SELECT "user", day, free_from, free_to FROM slots')
def free_slots(spark, sf_dir):
    return _slots(spark, sf_dir)


@query(BUSY + """SELECT a.day, a."user" AS a, b."user" AS b, greatest(a.free_from, b.free_from) AS common_from, least(a.free_to, b.free_to) AS common_to
  FROM slots a JOIN slots b ON a.day = b.day AND a."user" < b."user" AND a.free_from < b.free_to AND b.free_from < a.free_to
  WHERE least(a.free_to, b.free_to) - greatest(a.free_from, b.free_from) >= 200""")
def overlap_match(spark, sf_dir):
    return schedule.overlapping(_slots(spark, sf_dir), 200)


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    out = streams.windowed(table(spark, sf_dir, "events"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.]+', '[EMAIL]', 'g'), '\+?\d[\d ()-]{7,}\d', '[PHONE]', 'g') AS masked
  FROM conversations""")
def pii_masked(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", textops.mask(F.col("text")).alias("masked"))


@query("""SELECT ID, l_quantity FROM (SELECT l_orderkey AS ID, l_quantity FROM lineitem) ORDER BY l_quantity DESC, ID LIMIT 1000""")
def largest_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ID"), "l_quantity")
    return rows.orderBy(F.desc("l_quantity"), "ID").limit(1000)
