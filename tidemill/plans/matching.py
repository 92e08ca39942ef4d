"""Queries of matching by rules, beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import matching, recommend
from tidemill.plans.catalog import BIAS, BUSY, _slots, _split, query
from tidemill.runtime import table


@query(BUSY + """, o AS (SELECT a.day, a."user" AS x, b."user" AS y, least(a.free_to, b.free_to) - greatest(a.free_from, b.free_from) AS m FROM slots a JOIN slots b ON a.day = b.day AND a."user" <> b."user"
    WHERE least(a.free_to, b.free_to) - greatest(a.free_from, b.free_from) >= 200),
  s AS (SELECT x, y, sum(m) AS minutes, count(DISTINCT day) AS days FROM o GROUP BY 1, 2),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY minutes DESC, y) AS r FROM s) WHERE r <= 50)
  SELECT x AS "user", y AS mate, CAST(minutes AS BIGINT) AS minutes, days, rank FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY days DESC, minutes DESC, y) AS rank FROM f) WHERE rank <= 5""")
def mates(spark, sf_dir):
    return matching.mates(_slots(spark, sf_dir), 200)


@query("""WITH a(request, budget, minutes) AS (VALUES (1, 1000.0::DOUBLE, 10), (2, 1200.0::DOUBLE, 25), (3, 950.0::DOUBLE, 50), (4, 0.0::DOUBLE, 50))
  SELECT request, place, distance, price, rank FROM (SELECT request, p_partkey AS place, p_size AS distance, p_retailprice AS price,
    row_number() OVER (PARTITION BY request ORDER BY p_size, p_retailprice, p_partkey) AS rank FROM part JOIN a ON p_retailprice <= budget AND p_size <= minutes) WHERE rank <= 3""")
def venues(spark, sf_dir):
    """Parts stand in for places: their size for the way, their price for the bill."""
    asked = spark.createDataFrame([(1, 1000.0, 10), (2, 1200.0, 25), (3, 950.0, 50), (4, 0.0, 50)], "request int, budget double, minutes int")
    places = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.col("p_size").alias("distance"), F.col("p_retailprice").alias("price"))
    return matching.venues(asked, places)


@query("""WITH r AS (SELECT sha256(concat_ws('|', concat(length(user_id::VARCHAR), ':', user_id), coalesce(concat(length(event_type), ':', event_type), '-'))) AS id, event_id, user_id, event_type, value FROM events)
  SELECT id, event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id DESC) AS n FROM r) WHERE n = 1""")
def upserted_events(spark, sf_dir):
    """Every second event put into the others, by an id made of user and type: the latest stays."""
    rows = table(spark, sf_dir, "events").select(matching.content_id(F.col("user_id"), F.col("event_type")).alias("id"), "event_id", "user_id", "event_type", "value")
    return matching.upsert(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), "id", "event_id")


@query(BIAS + """, f AS (SELECT "user", item FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY pred DESC, item) AS r FROM predicted) WHERE r <= 3),
  e AS (SELECT "user", item FROM predicted WHERE actual >= 30),
  j AS (SELECT coalesce(f."user", e."user") AS "user", f.item AS fi, e.item AS ei FROM f FULL JOIN e ON f."user" = e."user" AND f.item = e.item)
  SELECT "user", count(CASE WHEN fi = ei THEN 1 END) AS matches, round(coalesce(count(CASE WHEN fi = ei THEN 1 END)::DOUBLE / nullif(count(fi), 0), 0), 6) AS precision,
    round(coalesce(count(CASE WHEN fi = ei THEN 1 END)::DOUBLE / nullif(count(ei), 0), 0), 6) AS recall FROM j GROUP BY 1""")
def match_counts(spark, sf_dir):
    predicted = recommend.bias_baseline(*_split(spark, sf_dir))
    return matching.match_counts(recommend.top_k(predicted, 3), predicted.filter("actual >= 30"), "user", "item")
