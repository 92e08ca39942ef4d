"""Queries of table and text preparation, beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import clean
from tidemill.operators import positions, textops
from tidemill.plans.catalog import TOKENS, TURNS, _pairs, query
from tidemill.runtime import table
from tidemill.sources import files

GRADE_CASES = {
    "taste": "CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END",
    "price": "CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END",
    "service": "CASE o_orderkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END",
}


@query(f"""SELECT CAST(o_orderkey AS INT) AS id, 'A B' AS item_name, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS gourmet, concat('name', o_custkey) AS user_name,
  (o_orderkey % 50) / 10.0::DOUBLE AS user_rating, CAST(o_custkey AS BIGINT) AS user_tot_follow_num, 'good food' AS user_query,
  {', '.join(f'CAST({sql} AS DOUBLE) AS {name}' for name, sql in GRADE_CASES.items())}, CAST(o_orderdate AS DATE) AS reviewed_at FROM orders""")
def typed_reviews(spark, sf_dir):
    """Raw review columns, as a page gives them, made of order rows, and typed again."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")

    def raw(name: str, by: int):
        out = F.lit("nan")
        for n, label in enumerate(files.GRADES[name]):
            out = F.when(key % by == n, label).otherwise(out)
        return out.alias(name)

    rows = orders.select(
        key.cast("int").alias("id"), F.lit(" A\r\nB ").alias("item_name"), F.lit("").alias("item_area"), F.lit("4.5점").alias("item_avg_rating"), F.lit("").alias("item_spec_area"),
        F.concat(F.concat(F.lit("name"), F.col("o_custkey")), F.when(key % 3 == 0, F.lit(f"\n{clean.BADGE}")).otherwise("")).alias("user_name"),
        F.lit("nan").alias("user_tot_avg_rating"), F.lit("1,234").alias("user_tot_rating_num"), F.concat(F.lit("팔로워 "), F.col("o_custkey")).alias("user_tot_follow_num"),
        F.concat((key % 50 / 10).cast("string"), F.lit("점")).alias("user_rating"), F.lit("good food" + clean.MORE).alias("user_query"),
        raw("taste", 4), raw("price", 5), raw("service", 7), F.lit("").alias("menu"), F.date_format("o_orderdate", "yyyy년 M월 d일").alias("reviewed_at"),
    )
    out = files.reviews(rows)
    return out.select("id", "item_name", "gourmet", "user_name", "user_rating", "user_tot_follow_num", "user_query", *[F.col(n).cast("double").alias(n) for n in GRADE_CASES], "reviewed_at")


@query("""SELECT conv_id, turn, text FROM conversations WHERE trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> '' AND trim(regexp_replace(coalesce(role, ''), '\\s+', ' ', 'g')) <> ''""")
def not_blank_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.filter(clean.not_blank(F.col("text"), F.col("role"))).select("conv_id", "turn", "text")


@query("SELECT CAST(i AS BIGINT) AS place, region FROM (SELECT unnest(['seoul', 'busan', 'gyeonggi', 'daegu']) AS region, generate_subscripts(['seoul', 'busan', 'gyeonggi', 'daegu'], 1) - 1 AS i)")
def list_items(spark, sf_dir):
    """The items of a comma-separated string, one row each."""
    return spark.range(1).select(F.posexplode(F.split(F.lit("seoul,busan,gyeonggi,daegu"), ","))).select(F.col("pos").cast("bigint").alias("place"), F.col("col").alias("region"))


@query("""SELECT vec_id, list_transform(list_transform(embedding[1:8], lambda x: exp(x::DOUBLE - list_max(embedding[1:8])::DOUBLE)),
    lambda e: round(e / list_sum(list_transform(embedding[1:8], lambda x: exp(x::DOUBLE - list_max(embedding[1:8])::DOUBLE))), 6))[1] AS first,
  round(list_max(embedding[1:8])::DOUBLE, 6) AS largest FROM embeddings""")
def softmax_first(spark, sf_dir):
    """Softmax over the first eight components: the first one's share, and the largest component."""
    head = F.slice(F.col("embedding").cast("array<double>"), 1, 8)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", head.alias("head"))
    return rows.select("vec_id", F.round(F.get(clean.softmax(F.col("head")), F.lit(0)), 6).alias("first"), F.round(F.array_max("head"), 6).alias("largest"))


@query("""SELECT vec_id, array_to_string(list_transform(list_reverse(list_sort(list_transform(generate_series(1, len(embedding)), lambda i: {'x': embedding[i], 'i': -i})))[1:5], lambda s: (-s.i - 1)::VARCHAR), ',') AS places,
  len(list_concat(embedding, embedding)) AS joined FROM embeddings""")
def vector_places(spark, sf_dir):
    """The places of the five largest components, largest first (ties to the earlier place), and the size of two vectors joined."""
    pairs = F.transform("embedding", lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    best = F.transform(F.slice(F.array_sort(pairs), 1, 5), lambda s: s["i"].cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(best, ",").alias("places"), F.size(F.concat("embedding", "embedding")).cast("bigint").alias("joined"))


@query("SELECT lang, max(length(coalesce(text, ''))) AS longest, min(length(coalesce(text, ''))) AS shortest FROM documents GROUP BY 1")
def text_lengths(spark, sf_dir):
    size = F.length(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.max(size).cast("bigint").alias("longest"), F.min(size).cast("bigint").alias("shortest")).orderBy("longest")


@query("SELECT event_type, round(avg(CASE WHEN event_id % 10 <> 0 THEN value END), 4) AS mean, count(CASE WHEN event_id % 10 <> 0 THEN value END) AS n FROM events GROUP BY 1")
def nan_means(spark, sf_dir):
    """Means that leave out NaN, which becomes null first."""
    value = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value").cast("double"))
    kept = clean.nan_to_null(value)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(kept), 4).alias("mean"), F.count(kept).alias("n"))


@query("""SELECT o_orderkey, o_custkey, place FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS place FROM orders) WHERE place < 100""")
def sampled_orders(spark, sf_dir):
    """A hundred rows in the order of a hash: a random sample that comes out alike on any cluster."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"))
    best = rows.orderBy("h", "o_orderkey").limit(100)
    return positions.with_position(best, "h", "o_orderkey", name="place").drop("h")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS place FROM orders""")
def shuffled_orders(spark, sf_dir):
    """All rows in the order of a hash, by place."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"))
    return positions.with_position(rows, "h", "o_orderkey", name="place").drop("h")


@query("""SELECT n_nationkey AS c0, n_name AS c1, n_regionkey AS c2 FROM nation""")
def leading_columns(spark, sf_dir):
    """The first three columns by position."""
    rows = table(spark, sf_dir, "nation")
    return rows.select(rows.columns[:3]).toDF("c0", "c1", "c2")


SPLIT_WORDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda x: x <> '')"


@query(TURNS + f""", t AS (SELECT id, {TOKENS.format('answer')} AS c, {TOKENS.format('question')} AS r FROM pairs WHERE question IS NOT NULL AND answer IS NOT NULL),
  cc AS (SELECT id, gram, count(*) AS c FROM (SELECT id, unnest(c) AS gram FROM t) GROUP BY 1, 2), rc AS (SELECT id, gram, count(*) AS r FROM (SELECT id, unnest(r) AS gram FROM t) GROUP BY 1, 2),
  s AS (SELECT sum(coalesce(c, 0))::DOUBLE AS c, sum(coalesce(r, 0))::DOUBLE AS r, sum(least(coalesce(c, 0), coalesce(r, 0)))::DOUBLE AS h FROM cc FULL JOIN rc ON cc.id = rc.id AND cc.gram = rc.gram)
  SELECT round(CASE WHEN c >= r THEN 1.0 ELSE exp(1 - r / nullif(c, 0)) END * CASE WHEN h = 0 THEN 0.1 ELSE h END / nullif(c, 0), 6) AS bleu1 FROM s""")
def bleu1_smoothed(spark, sf_dir):
    """Corpus BLEU-1 against the second text, over rows with both texts; no hit at all counts as a tenth of one."""
    rows = _pairs(spark, sf_dir).filter(F.col("question").isNotNull() & F.col("answer").isNotNull())
    return textops.bleu1(rows, "id", "answer", "question", smooth=0.1)


@query(TURNS + """SELECT id, question AS original, answer AS simplified_human, concat('x ', answer) AS simplified_by_model FROM pairs""")
def output_table(spark, sf_dir):
    """Originals, human texts where there are any, and model texts, in that order of columns."""
    rows = _pairs(spark, sf_dir)
    out = rows.select("id", F.col("question").alias("original"), F.concat(F.lit("x "), F.coalesce("answer", F.lit(""))).alias("simplified_by_model"), F.col("answer").alias("simplified_human"))
    return textops.assembled(out, "id", "original", "simplified_by_model", "simplified_human")


@query(f"SELECT doc_id, len({SPLIT_WORDS.format('text')}) AS n_words FROM documents")
def white_space_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(textops.words(F.col("text"))).cast("bigint").alias("n_words"))


PAGE = {"title": "<title>([^<]*)</title>", "heading": "<h1[^>]*>([^<]*)</h1>", "link": "href=\"([^\"]*)\"", "paragraph": "<p[^>]*>([^<]*)</p>"}


@query("SELECT page_id, " + ", ".join(f"coalesce(nullif(regexp_extract(coalesce(html, ''), '{p}', 1), ''), 'nan') AS {n}" for n, p in PAGE.items()) + " FROM pages")
def page_fields(spark, sf_dir):
    """Fields of a page, ``nan`` where it lacks one."""
    out = textops.html_fields(table(spark, sf_dir, "pages"), "page_id", "html", PAGE)
    return out.fillna("nan", list(PAGE))


@query("SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '<p[ >]')) AS n_paragraphs FROM pages")
def paragraphs(spark, sf_dir):
    """How many elements of a kind a page has, by a parser."""
    return textops.counted(table(spark, sf_dir, "pages"), "page_id", "html", "p", "n_paragraphs")
