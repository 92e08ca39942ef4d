"""Queries of recommendations and of their evaluation, beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import clean
from tidemill.operators import positions, recommend
from tidemill.plans.catalog import BIAS, FACTORS, SPLITS, UI, USERS, _split, _ui, query
from tidemill.runtime import materialize, table

KNOWN = BIAS + """, known AS (SELECT * FROM predicted WHERE "user" IN (SELECT "user" FROM train) AND item IN (SELECT item FROM train) AND item % 3 <> 0),
  held AS (SELECT t."user", t.item, t.rating AS actual, k.pred, pow(2, t.rating / 50.0::DOUBLE) - 1 AS gain FROM test t LEFT JOIN known k ON k."user" = t."user" AND k.item = t.item
    WHERE t."user" IN (SELECT "user" FROM known)),
  ranked AS (SELECT *, CASE WHEN pred IS NOT NULL THEN row_number() OVER (PARTITION BY "user" ORDER BY pred DESC NULLS LAST, item) END AS p,
    row_number() OVER (PARTITION BY "user" ORDER BY actual DESC, item) AS a FROM held),
  per_user AS (SELECT "user", count(*) AS n, sum(CASE WHEN p <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS hits, sum(CASE WHEN p <= 3 AND a <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS both_top,
    sum(CASE WHEN p <= 3 THEN gain / log2(p + 1) ELSE 0 END) AS dcg, sum(CASE WHEN a <= 3 THEN gain / log2(a + 1) ELSE 0 END) AS ideal FROM ranked GROUP BY 1)"""


@query(KNOWN + """SELECT round(avg(hits / 3), 6) AS precision_at_k, round(avg(hits / n), 6) AS recall_at_k, round(avg(both_top / 3), 6) AS hit_rate_at_k,
  round(avg(coalesce(dcg / nullif(ideal, 0), 0)), 6) AS ndcg_at_k FROM per_user""")
def metrics_of_known(spark, sf_dir):
    """Metrics where a part of the test rows has no prediction: recall counts those as well."""
    train, test = _split(spark, sf_dir)
    known = recommend.known_pairs(test, train).filter("item % 3 <> 0")
    return recommend.ranking_metrics(recommend.bias_baseline(train, known), test=test)


@query(BIAS + """, good AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY pred DESC, item) AS p, row_number() OVER (PARTITION BY "user" ORDER BY actual DESC, item) AS a
    FROM predicted WHERE actual >= 20),
  pu AS (SELECT u."user", count(g.item)::DOUBLE / 3 AS recall FROM (SELECT DISTINCT "user" FROM predicted) u LEFT JOIN good g ON g."user" = u."user" AND p <= 3 AND a <= 3 GROUP BY 1)
  SELECT round(avg(recall), 6) AS recall_at_k FROM pu""")
def recall_of_good(spark, sf_dir):
    return recommend.threshold_recall(recommend.bias_baseline(*_split(spark, sf_dir)), 3, 20.0)


@query(BIAS + """, r AS (SELECT *, pow(2, actual / 50.0::DOUBLE) - 1 AS gain, row_number() OVER (PARTITION BY "user" ORDER BY pred DESC, item) AS p FROM predicted),
  best AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY gain DESC) AS a FROM r),
  s AS (SELECT "user", sum(CASE WHEN p <= 10 THEN gain / log2(p + 1) ELSE 0 END) AS dcg, sum(CASE WHEN a <= 10 THEN gain / log2(a + 1) ELSE 0 END) AS ideal FROM best GROUP BY 1)
  SELECT "user", round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg FROM s""")
def ndcg_by_user(spark, sf_dir):
    return recommend.ndcg_vector(recommend.bias_baseline(*_split(spark, sf_dir)), 10)


@query(BIAS + """, own AS (SELECT * FROM predicted WHERE "user" = 1 AND actual >= 10), t AS (SELECT item FROM own ORDER BY actual DESC, item LIMIT 10),
  p AS (SELECT item FROM own ORDER BY pred DESC, item LIMIT 10) SELECT count(*) AS hits, round(count(*) / 10.0::DOUBLE, 6) AS share FROM p WHERE item IN (SELECT item FROM t)""")
def hits_of_user(spark, sf_dir):
    return recommend.user_hits(recommend.bias_baseline(*_split(spark, sf_dir)), 1, 10, 10.0)


@query(BIAS + """SELECT c_name AS name, item, pred, actual FROM predicted JOIN customer ON c_custkey = "user" WHERE "user" = 4 ORDER BY pred DESC, item LIMIT 5""")
def top_p_by_id(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_name").alias("name"))
    return recommend.top_p(recommend.bias_baseline(*_split(spark, sf_dir)), 5, 4, names)


@query(BIAS + """SELECT c_name AS name, item, pred, actual FROM predicted JOIN customer ON c_custkey = "user" WHERE c_name = (SELECT c_name FROM customer WHERE c_custkey = 7)
  ORDER BY pred DESC, item LIMIT 5""")
def top_p_by_name(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_name").alias("name"))
    name = names.filter("user = 7").head()["name"]
    return recommend.top_p(recommend.bias_baseline(*_split(spark, sf_dir)), 5, name, names)


@query(BIAS + """, c AS (SELECT u."user", i.item FROM (SELECT DISTINCT "user" FROM train WHERE "user" <= 20) u CROSS JOIN (SELECT DISTINCT item FROM train) i
    WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t."user" = u."user" AND t.item = i.item)),
  s AS (SELECT "user", item, round(mu + coalesce(u - mu, 0) + coalesce(i - mu, 0), 6) AS pred FROM c LEFT JOIN u USING ("user") LEFT JOIN i USING (item) CROSS JOIN mu)
  SELECT "user", item, pred, rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY pred DESC, item) AS rank FROM s) WHERE rank <= 5""")
def candidate_top_n(spark, sf_dir):
    """All items that a user doesn't have in training, scored, for a batch of twenty users."""
    train, _ = _split(spark, sf_dir)
    users = train.select("user").filter("user <= 20").distinct()
    pairs = recommend.candidates(users, train.select("item").distinct(), train).withColumn("rating", F.lit(None).cast("double"))
    return recommend.top_k(recommend.bias_baseline(train, pairs).drop("actual"), 5)


@query(USERS + """, near AS (SELECT a AS "user", b AS other, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM both_ways) WHERE r <= 5),
  s AS (SELECT near."user", ui.item, round(sum(sim * rating) / nullif(sum(sim), 0), 6) AS score FROM near JOIN ui ON ui."user" = near.other GROUP BY 1, 2),
  f AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM ui WHERE ui."user" = s."user" AND ui.item = s.item))
  SELECT "user", item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM f) WHERE rank <= 3""")
def neighbour_top_n(spark, sf_dir):
    ui = materialize(_ui(spark, sf_dir), "ui")
    return recommend.neighbour_candidates(ui, 5, 3)


@query(f"""WITH v(i, f, w) AS (SELECT i + 1, f, ((i * 7 + f * 3) % 11 - 5) / 10.0::DOUBLE FROM range(64) a(i), range(4) b(f)),
  z AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  q AS (SELECT vec_id, sum(t) * 0.5 AS q FROM (SELECT vec_id, f, pow(sum(x * w), 2) - sum(x * x * w * w) AS t FROM z JOIN v USING (i) GROUP BY 1, 2) GROUP BY 1),
  l AS (SELECT vec_id, sum(x * w) AS l FROM z JOIN v USING (i) WHERE f = 0 GROUP BY 1)
  SELECT vec_id, 3.5::DOUBLE AS global_bias, round(l, 5) AS linear_term, round(q, 5) AS quadratic_term, round(3.5::DOUBLE + l + q, 5) AS pred FROM q JOIN l USING (vec_id)""")
def prediction_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", *recommend.decompose(F.col("embedding"), 3.5, [f[0] for f in FACTORS], FACTORS))


@query(UI + """, m AS (SELECT min(rating) AS lo, max(rating) AS hi FROM ui)
  SELECT "user", item, round((rating - lo) / nullif(hi - lo, 0), 9) AS scaled, round((rating - lo) / nullif(hi - lo, 0) * (hi - lo) + lo, 6) AS back,
    round(least(greatest((rating - lo) / nullif(hi - lo, 0) * 1.5 - 0.2, 0.0), 1.0), 9) AS clamped FROM ui CROSS JOIN m""")
def scaled_ratings(spark, sf_dir):
    """Ratings to 0..1 and back, and a score cut to 0..1."""
    ui = _ui(spark, sf_dir)
    ends = ui.agg(F.min("rating").alias("lo"), F.max("rating").alias("hi"))  # one row
    rows = ui.join(F.broadcast(ends))
    scaled = clean.min_max(F.col("rating"), F.col("lo"), F.col("hi"))
    back = clean.from_min_max(scaled, F.col("lo"), F.col("hi"))
    return rows.select("user", "item", F.round(scaled, 9).alias("scaled"), F.round(back, 6).alias("back"), F.round(clean.clamp01(scaled * 1.5 - 0.2), 9).alias("clamped"))


@query(UI + 'SELECT "user", item, CASE WHEN rating > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS seen FROM ui WHERE rating >= 20')
def binarised(spark, sf_dir):
    """Ratings of at least a threshold, as 1."""
    return _ui(spark, sf_dir).filter("rating >= 20").select("user", "item", F.when(F.col("rating") > 0, 1.0).otherwise(0.0).alias("seen"))


@query(SPLITS + """, domain AS (SELECT DISTINCT item FROM ui)
  SELECT d.item, coalesce(round(avg(t.rating), 6), 2.0::DOUBLE) AS mean FROM domain d LEFT JOIN train t ON t.item = d.item GROUP BY 1""")
def aligned_items(spark, sf_dir):
    """Training means of every item there is; items without training rows get 2."""
    train, test = _split(spark, sf_dir)
    items = train.select("item").union(test.select("item")).distinct()
    means = train.groupBy("item").agg(F.round(F.avg("rating"), 6).alias("mean"))
    return items.join(means, "item", "left").fillna(2.0, ["mean"])


@query(UI + """, p AS (SELECT *, ntile(5) OVER (ORDER BY "user", item) AS fold FROM ui), f AS (SELECT fold, sqrt(avg(pow(rating - 25, 2))) AS rmse FROM p GROUP BY 1)
  SELECT round(avg(rmse), 6) AS mean_rmse, count(*) AS folds FROM f""")
def mean_of_folds(spark, sf_dir):
    """The mean over folds of the error of a constant prediction."""
    rows = positions.folds(_ui(spark, sf_dir), 5, "user", "item")
    error = F.col("rating") - 25
    by_fold = rows.groupBy("fold").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    return by_fold.agg(F.round(F.avg("rmse"), 6).alias("mean_rmse"), F.count(F.lit(1)).alias("folds"))


@query()
def mf_sgd(spark, sf_dir):
    """Stratified gradient descent for a few epochs, and its predictions of the test rows."""
    train, test = _split(spark, sf_dir)
    model = recommend.block_sgd(train, k=4, rate=0.02, epochs=2, blocks=4)
    return recommend.block_sgd_predict(model, test)
