import json
import math
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import clean
from tidemill.operators import positions, recommend, retail, schedule, textops
from tidemill.runtime import table
from tidemill.sources import files, sinks


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).head()[0]


@pytest.mark.parametrize("raw, want", [("4.5점", 4.5), ("nan", None), ("", None), (None, None), ("5", 5.0)])
def test_rating(spark, raw, want):
    assert one(spark, clean.parse_rating, raw) == want


def test_clean_functions(spark):
    assert one(spark, clean.clean_text, " a\r\nb\rc\nd ") == "a b c d"
    assert one(spark, clean.clean_text, None) == ""
    assert str(one(spark, clean.parse_korean_date, "2025년 3월 21일")) == "2025-03-21"
    assert one(spark, clean.parse_korean_date, "soon") is None
    assert one(spark, clean.badge_flag, "kim 다코미식가") == 1
    assert one(spark, clean.without_badge, "kim 다코미식가\n") == "kim"
    assert one(spark, clean.without_more, "good...더보기\n") == "good"
    assert one(spark, clean.digits_to_int, "1,234 reviews") == 1234
    assert one(spark, clean.digits_to_int, "none") is None
    assert one(spark, lambda c: clean.ordinal(c, "g", "f", "p"), "f") == 1
    assert one(spark, lambda c: clean.ordinal(c, "g", "f", "p"), "?") is None


@pytest.mark.parametrize(
    "generated, want",
    [
        ("<start_of_turn>user\nq<end_of_turn>\n<start_of_turn>model\n an answer <end_of_turn>rest", "an answer"),
        ("q then the answer<eos>x", "then the answer"),
        ("only text", "only text"),
        ("<start_of_turn>model\nx<eos>y<end_of_turn>", "x"),
    ],
)
def test_response(spark, generated, want):
    assert one(spark, lambda c: clean.response(c, F.lit("q ")), generated) == want


def test_prompt_null(spark):
    assert one(spark, lambda c: clean.prompt(c, F.lit("a")), None) is None


def test_pad(spark):
    assert one(spark, lambda c: clean.pad(c, 4), [1, 2], "array<bigint>") == [1, 2, 0, 0]
    assert one(spark, lambda c: clean.pad(c, 1), [1, 2], "array<bigint>") == [1]


def test_split_adds_up(spark, small):
    fact = retail.sales_fact(spark, small)
    for row in retail.split_by(fact, "n_name").collect():
        assert math.isclose(row.total, row.loss + row.gain, abs_tol=0.02)
    n = fact.count()
    assert sum(r.n for r in retail.discount_buckets(fact).collect()) == n
    assert sum(r.n for r in retail.monthly(fact).collect()) == n


def test_bucket_edges(spark):
    rows = spark.createDataFrame([(0.0,), (0.4,), (1.0,), (1.2,), (None,)], "d double").select(retail.bucket(F.col("d"), 10, 10).alias("b"))
    assert [r.b for r in rows.collect()] == [0, 4, 9, None, None]


def test_constant_correlation(spark):
    assert retail.correlation(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").head()[0] is None


def test_dashboard(spark, small):
    document = json.loads(retail.dashboard(retail.sales_fact(spark, small)).head()[0])
    order = "meta kpi monthly_series by_sub_category by_market_area by_order_region discount_buckets headline tables_by_manufacturer ship_mode_dist eta_dist"
    assert list(document) == order.split()
    assert sum(r["n"] for r in document["ship_mode_dist"]) == document["kpi"]["n_transactions"] == document["meta"]["n_transactions"]
    assert [r["bucket"] for r in document["discount_buckets"]] == [f"{i}-{i + 1}%" for i in range(11)]
    totals = [r["total"] for r in document["by_sub_category"]]
    assert totals == sorted(totals) and len(document["kpi"]["yoy_transaction_growth_pct"]) > 1


def test_round_trip_of_split(spark):
    flat = spark.createDataFrame([(1, "a", 2.0), (2, "b", None)], "k int, x string, y double")
    parts = retail.vertical_split(flat, "k", {"p": ["x"], "q": ["y"]})
    assert sorted(retail.reassemble(parts, "k").collect()) == sorted(flat.collect())


def test_positions(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert sorted((r.v, r.position) for r in positions.with_position(rows, "v").collect()) == [(i, i) for i in range(1000)]
    counts = positions.folds(rows.limit(7), 3, "v").groupBy("fold").count().collect()
    assert sorted((r.fold, r["count"]) for r in counts) == [(1, 3), (2, 2), (3, 2)]


def test_holdout_sizes(spark):
    rows = spark.createDataFrame([(u, i, 1.0) for u in range(1, 8) for i in range(u)], "user long, item long, rating double")
    got = {r.user: r.n for r in positions.holdout(rows).filter("split = 'train'").groupBy("user").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6}


def test_precision_identity(spark):
    rows = [(u, i, float(i), float(-i)) for u, n in ((1, 2), (2, 5)) for i in range(n)]
    out = recommend.ranking_metrics(spark.createDataFrame(rows, "user long, item long, actual double, pred double")).head()
    assert out.precision_at_k == round((2 / 3 + 1) / 2, 6)
    assert out.recall_at_k == round((1 + 3 / 5) / 2, 6)


def test_cosine_bounds(spark, small):
    sims = recommend.cosine(recommend.interactions(spark, small), "user", "item").agg(F.max("sim"), F.min("sim")).head()
    assert 0 <= sims[1] <= sims[0] <= 1


def test_cosine_of_one_shared(spark):
    rows = [(1, 1, 3.0), (1, 2, 4.0), (2, 2, 1.0), (2, 3, 2.0), (3, 1, 5.0), (3, 3, 6.0)]
    dense = np.zeros((4, 4))
    for u, i, r in rows:
        dense[u, i] = r
    got = {(r.a, r.b): r.sim for r in recommend.cosine(spark.createDataFrame(rows, "user long, item long, rating double"), "item", "user").collect()}
    unit = dense[1:, 1:] / np.linalg.norm(dense[1:, 1:], axis=0)
    assert got == {(a + 1, b + 1): pytest.approx((unit.T @ unit)[a, b], abs=1e-6) for a in range(3) for b in range(a + 1, 3)}


def sequential(rows, p, q, mu, rate, reg, epochs):
    """The update rule one rating after the other."""
    for _ in range(epochs):
        for u, i, r in sorted(rows):
            error = r - (sum(x * y for x, y in zip(p[u][:-1], q[i][:-1], strict=True)) + p[u][-1] + q[i][-1] + mu)
            bu, bi = p[u][-1] + rate * (error - reg * p[u][-1]), q[i][-1] + rate * (error - reg * q[i][-1])
            fu = [x + rate * (error * y - reg * x) for x, y in zip(p[u][:-1], q[i][:-1], strict=True)]
            fi = [y + rate * (error * x - reg * y) for x, y in zip(fu, q[i][:-1], strict=True)]
            p[u], q[i] = [*fu, bu], [*fi, bi]


def test_gradient_descent(spark):
    rows = [(u, i, float((u + i) % 3)) for u in range(8) for i in range(6) if (u * i) % 5 != 4]
    train = spark.createDataFrame(rows, "user long, item long, rating double")
    model = recommend.block_sgd(train, k=3, rate=0.05, epochs=2, blocks=1)
    p, q = ({r.id: list(r.f) for r in recommend._first_factors(train, e, 3, 42, 1).collect()} for e in ("user", "item"))
    means = {}
    for _, i, r in rows:
        means.setdefault(i, []).append(r)
    assert model["mu"] == pytest.approx(np.mean([np.mean(v) for v in means.values()]))
    sequential(rows, p, q, model["mu"], 0.05, 0.02, 2)
    for found, want in ((model["p"], p), (model["q"], q)):
        assert {r.id: pytest.approx(list(r.f)) for r in found.collect()} == want
    before = recommend.rmse(recommend.block_sgd_predict({**model, "p": recommend._first_factors(train, "user", 3, 42, 1), "q": recommend._first_factors(train, "item", 3, 42, 1)}, train)).head()[0]
    strata = recommend.block_sgd(train, k=3, rate=0.05, epochs=3, blocks=3, valid=train, patience=1)
    assert len(strata["errors"]) == 3 and strata["errors"][-1] == min(strata["errors"]) < before
    cases = spark.createDataFrame([(0, 0, 1.0), (0, 99, 1.0), (99, 0, 1.0), (99, 99, 1.0)], "user long, item long, rating double")
    got = {(r.user, r.item): r.pred for r in recommend.block_sgd_predict(model, cases).collect()}
    assert got[99, 99] == pytest.approx(model["mu"], abs=1e-6)
    assert got[0, 99] == pytest.approx(sum(p[0][:-1]) + p[0][-1] + model["mu"], abs=1e-5) and got[99, 0] == pytest.approx(sum(q[0][:-1]) + q[0][-1] + model["mu"], abs=1e-5)


def test_full_rank_svd(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 5.0]), (3, [0.5, -1.0])], "k int, v array<double>")
    for row in recommend.svd(rows, "k", "v", 2).collect():
        assert np.allclose(row.v, row.approximation)


def test_text_metrics(spark):
    assert textops.lcs_length("a b c d".split(), "b x d".split()) == 2
    assert textops.rouge_l_score("a b", "a b") == 1.0
    assert textops.rouge_l_score(None, "a") == 0.0
    rows = spark.createDataFrame([(1, "a b c", "a b c", "a b c"), (2, None, None, None), (3, "a b c d", "a b x", "a y x")], "id int, s string, c string, r string")
    got = {r.id: r.sari for r in textops.sari(rows, "id", "s", "c", "r").collect()}
    assert got[1] == 100.0 and got[2] == 100.0 and 0 < got[3] < 100


def plain_grade(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if not words:
        return None
    total = 0
    for word in words:
        n = len(re.findall(f"[{textops.VOWELS}]+", word))
        total += max(1, n - (word.endswith("e") and n > 1))
    sentences = max(1, len([x for x in re.split("[.!?]+", text) if x.strip()]))
    return round(0.39 * len(words) / sentences + 11.8 * total / len(words) - 15.59, 6)


def test_reading_grade(spark):
    texts = ["", None, "table", "The agreeable tree. Be free! one??two", "rhythm eee aebece 12 e", "banana  ... !", "École élève crème brûlée tse tse-tse"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", textops.fkgl(F.col("t")).alias("g")).collect()
    assert [r.g for r in sorted(rows)] == [plain_grade(t) for t in texts]


@pytest.mark.parametrize("name", ["taste", "price", "service"])
def test_review_grades(spark, name):
    columns = [c.split()[0] for c in files.REVIEWS.split(", ")]
    rows = [tuple(i if c == "id" else g if c == name else "?" for c in columns) for i, g in enumerate([*files.GRADES[name], "nan", None])]
    out = files.reviews(spark.createDataFrame(rows, files.REVIEWS)).orderBy("id").collect()
    assert [r[name] for r in out] == [2, 1, 0, None, None]


def test_response_without_tag(spark):
    rows = spark.createDataFrame([("ask me: answer <eos> x", "ask me:"), ("plain <end_of_turn>", "other"), ("x ask y", "ask")], "g string, p string")
    out = rows.select(clean.response(F.col("g"), F.col("p")).alias("r")).collect()
    assert [r.r for r in out] == ["answer", "plain", "sk y"]  # as many characters as the prompt has, wherever it is


def test_tables(spark, tmp_path):
    name = f"t{uuid.uuid4().hex[:8]}"
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    spark.sql(f"CREATE TABLE {name} (k int, v string) USING parquet LOCATION '{tmp_path}/{name}'")
    sinks.insert_select(frame.select("v", "k"), name)
    sinks.insert_values(spark, name, [(3, "c")])
    assert sorted(spark.table(name).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    sinks.drop_tables(spark, name, name)
    assert not spark.catalog.tableExists(name)
    sinks.json_document(spark.createDataFrame([('{"a": "ä"}',)], "document string"), f"file://{tmp_path}/doc")
    assert spark.read.text(f"file://{tmp_path}/doc").head()[0] == '{"a": "ä"}'
    (tmp_path / "one.csv").write_text("a\n1\n")
    assert files.tables(spark, f"file://{tmp_path}", {"one": "a int"})["one"].collect() == spark.sql("SELECT * FROM one").collect() == [(1,)]
    with pytest.raises(ValueError):
        files.require_rows(frame.limit(0))
    assert files.require_rows(frame) is frame


def test_jdbc(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    sinks.jdbc(spark.range(2500).select(F.col("id").alias("k")), url, "numbers", batch=1000, **options)
    assert files.jdbc(spark, url, "numbers", **options).count() == 2500


def test_shared_folder_is_needed_on_clusters(spark, monkeypatch):
    from tidemill import runtime

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


def test_only_the_optional_modules_may_be_missing(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    load = builtins.__import__

    def missing(name):
        def run(wanted, *rest, **more):
            if wanted.startswith("tidemill.llm"):
                raise ModuleNotFoundError(f"no {name}", name=name)
            return load(wanted, *rest, **more)

        return run

    monkeypatch.setattr(builtins, "__import__", missing("tidemill.llm"))
    assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    monkeypatch.setattr(builtins, "__import__", missing("xxhash"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_html():
    assert textops.select_html('<div class="t x">a<b>b</b></div><div>c</div>', "div", "t") == ["ab"]


def test_free_time(spark):
    busy = spark.createDataFrame([(1, "d", 600, 700), (1, "d", 690, 720), (1, "d", 800, 950)], "user long, day string, start long, end long")
    assert [(r.free_from, r.free_to) for r in schedule.free_slots(busy, 660, 900).collect()] == [(720, 800)]


def test_files(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿a,b\n1,\"x\ny\"\n".encode())
    assert files.csv(spark, f"file://{tmp_path}/r.csv", "a int, b string").collect() == [(1, "x\ny")]
    (tmp_path / "u.data").write_text("1\t2\t3\t4\n")
    assert files.tsv(spark, f"file://{tmp_path}/u.data", columns=["user", "rating"]).collect() == [(1, 3.0)]
    (tmp_path / "p.txt").write_bytes("1|Café\n".encode("latin-1"))
    assert files.pipe(spark, f"file://{tmp_path}/p.txt", "k int, v string").collect() == [(1, "Café")]
    assert files.csv_or_default(spark, f"file://{tmp_path}/none.csv", "a int", [(5,)]).collect() == [(5,)]
    (tmp_path / "w.txt").write_text("2 2\na 1 2\nb 3 4\n")
    assert files.word_vectors(spark, f"file://{tmp_path}/w.txt").collect() == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    with pytest.raises(ValueError):
        files.require_columns(spark.range(1), "x")


def test_sinks(spark, tmp_path):
    sinks.csv(spark.createDataFrame([("b",), ("a",)], "v string"), f"file://{tmp_path}/out", index_by=["v"])
    assert sorted(spark.read.option("header", True).csv(f"file://{tmp_path}/out").collect()) == [("0", "a"), ("1", "b")]
    path = f"file://{tmp_path}/runs"
    sinks.log_run(spark, path, "x", {"k": "1"}, {"rmse": 2.0})
    sinks.log_run(spark, path, "y", {"k": "2"}, {"rmse": 1.0})
    assert [r.run for r in sinks.compare_runs(spark.read.parquet(path), ["k"], ["rmse"], "rmse").collect()] == ["y", "x"]


def test_reviews(spark):
    raw = {c.split()[0]: None for c in files.REVIEWS.split(", ")} | {"id": 1, "user_rating": "4.5점", "taste": "맛: 좋음", "price": "?", "reviewed_at": "2025년 3월 21일", "user_query": "ok...더보기\n", "user_name": "kim다코미식가"}
    row = files.reviews(spark.createDataFrame([tuple(raw.values())], files.REVIEWS)).head()
    assert (row.user_rating, row.taste, row.price, str(row.reviewed_at), row.user_query, row.gourmet) == (4.5, 2, None, "2025-03-21", "ok", 1)


def test_pushdown(spark, small):
    plan = table(spark, small, "lineitem").filter("l_quantity > 40").select("l_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan and "l_tax" not in plan


def test_stream_equals_batch(spark, small, tmp_path):
    from tidemill.streaming import events

    batch = events.windowed(table(spark, small, "events")).collect()
    schema = table(spark, small, "events").schema
    table(spark, small, "events").write.parquet(f"file://{tmp_path}/events")
    stream = events.windowed(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/events"))
    running = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    running.processAllAvailable()
    running.stop()
    assert sorted(spark.table("windows").collect()) == sorted(batch)
