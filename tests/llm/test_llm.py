import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import ann, bpe, decontaminate, langid, line_dedup, neardup, quality, secrets, sharding, token_counts
from tidemill.llm.queries import ORACLES, QUERIES
from tidemill.runtime import materialize, table

import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [None, "", " \n\t ", "a", "x" * 5000, " " * 3000, "é😀 日本\r\nfoo's 123", "<|endoftext|> a", "word " * 4000]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in enumerate(texts)], DOCS)


# --- 1, 9: tokens ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("leaf", [1, 3, 64, 2048])
def test_bpe_tree(leaf):
    import public_tokenizers

    whole = bpe.codec()
    tree = bpe.Codec({t: r for r, t in enumerate(whole.vocab)}, public_tokenizers.PATTERN, leaf)
    draw = random.Random(leaf)
    parts = ["a", "aa", "b", " ", "  ", "\n", "é", "the", "'", "'s", "!", "9", "\t", "日", "\x1c", "\x85"]
    for text in EDGE[1:] + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 80))) for _ in range(1500)]:
        ids = tree.encode(text)
        assert ids == whole._library.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()


def test_bpe_query(spark):
    tool = bpe.codec()
    for row in bpe.digests(docs(spark, EDGE).withColumn("ids", F.lit(1))).collect():
        ids = tool._library.encode_ordinary(EDGE[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((EDGE[row.doc_id] or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs(spark, EDGE))).collect()
    assert all(bytes(r.text) == (EDGE[r.doc_id] or "").encode() for r in back)


def test_token_counts(spark):
    tool = token_counts.pre_tokens(token_counts.VOCAB)
    texts = [*EDGE, *EDGE, "<|endoftext|><|endoftext|>", "<|end"]
    for row in token_counts.lengths(docs(spark, texts)).collect():
        text = texts[row.doc_id] or ""
        assert row.n_tokens == len(tool._library.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.over_limit) == (len(text.encode()), row.n_tokens > 512)


# --- 2: secrets ----------------------------------------------------------------------------------------------------------
def base_spans(text):
    assign = re.compile(secrets.ASSIGN.removeprefix("(?i)"), re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, text) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets(spark):
    texts = [*EDGE, "token=api_key: 'abcdefghijklmn", "😀 Password = \"AbC_123456789\" x" * 3, "AKIA" + "Z9" * 9 + " deadbeefdeadbeef0", "secret:" + "a" * 12]
    for row in secrets.listing(docs(spark, texts)).collect():
        spans = base_spans(texts[row.doc_id] or "")
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == n for _, k, _ in spans) for n in range(3)]


def entropy_spans(text):
    """Every candidate by Python's patterns, every window counted anew."""
    taken = [(s, e) for s, _, e in base_spans(text)]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        word = m[0]
        if any(s < m.end() and m.start() < e for s, e in taken) or not re.search("[0-9]", word) or not re.search("[A-Za-z]", word):
            continue
        if any(re.search(p.replace("++", "+"), word) for p in secrets.ALLOWED):
            continue
        best = 0.0
        for i in range(len(word) - 19):
            best = max(best, -sum(c / 20 * math.log2(c / 20) for c in Counter(word[i : i + 20]).values()))
        kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", word) else "upper" if re.fullmatch("[0-9A-Z]+", word) else "alnum"
        if not re.fullmatch("[0-9A-Za-z]+", word):
            kind = "base64"
        if best >= secrets.LIMITS[kind]:
            yield m.start(), 3, m.end()


def test_entropy(spark):
    draw = random.Random(5)
    letters = ["abcdefghijKLMNOP0123456789", "ab1", "0123456789abcdef", "ABCDEFGH012345", secrets.ALPHABET]
    words = ["".join(draw.choice(draw.choice(letters)) for _ in range(draw.randint(10, 60))) for _ in range(200)]
    glue = [" ", "\n", ".", "token=", " password: ", "\x01", "😀", " AKIA", "deadbeefdeadbeef", "/usr/lib/", "2024-01-01"]
    texts = ["".join(draw.choice(words) + draw.choice(glue) for _ in range(draw.randint(1, 12))) for _ in range(150)]
    texts += ["550e8400-e29b-41d4-a716-446655440000", "v1-22-333-4444-55555-66666-777777", "abc12/def/ghi_jkl-mno/pq", "see wJalrXUtnFEMI7K9MDENGbPxRfiCYzq8 now"]
    got = {r.doc_id: r.spans for r in secrets.listing(docs(spark, texts)).collect()}
    total = 0
    for i, text in enumerate(texts):
        spans = sorted([*base_spans(text), *entropy_spans(text)])
        total += sum(k == 3 for _, k, _ in spans)
        assert got[i] == ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    assert total > 100 and got[len(texts) - 1] == "entropy:4:36"


def test_secrets_sql(spark):
    import duckdb
    import pandas as pd

    draw = random.Random(15)
    words = ["".join(draw.choice(secrets.ALPHABET[: draw.choice([16, 36, 62, 67])]) for _ in range(draw.randint(5, 50))) for _ in range(80)]
    glue = [" ", "\n", ".", "token=", " Api_Key: '", "\x01", "é😀", " AKIA", "deadbeefdeadbeef", "/usr/lib/", "2024-01-01", "aaaaaaaaa", "0" * 9]
    texts = [*EDGE, *("".join(draw.choice(words) + draw.choice(glue) for _ in range(draw.randint(1, 9))) for _ in range(120))]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    want = duckdb.sql(ORACLES["op2_secret_scan"]).df().set_index("doc_id")
    got = secrets.listing(docs(spark, texts)).toPandas().set_index("doc_id")
    assert sorted(got.columns) == sorted(want.columns)
    for i in range(len(texts)):
        assert got.loc[i].to_dict() == want.loc[i].to_dict()
    assert got["n_entropy"].sum() > 50


def test_long_texts(spark):
    """Texts that made patterns recurse or work grow with the square: results come, and in seconds."""
    draw = random.Random(6)
    size = 300_000
    texts = [
        "".join(draw.choice(secrets.ALPHABET) for _ in range(size)), "ab1/" * (size // 4), "1," * (size // 2), "1-" * (size // 2), "AKIA" * (size // 4),
        " ".join("".join(draw.choice("0123456789abcdef") for _ in range(n)) for n in (6, 20) for _ in range(size // 20)),
        " ".join(f"token=abcdefgh{i:05d}Zq" for i in range(size // 20)),
    ]
    began = time.monotonic()
    for row in secrets.listing(docs(spark, texts)).collect():
        spans = base_spans(texts[row.doc_id])
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert time.monotonic() - began < 90


def test_secrets_shapes(spark):
    empty = secrets.listing(docs(spark, ["a"]).limit(0))
    assert empty.count() == 0 and empty.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    twice = docs(spark, ["token=abcdefghijkl"]).union(docs(spark, ["token=abcdefghijkl"])).withColumn("secret_spans", F.lit(1)).withColumn("spans", F.lit("x"))
    assert [(r.n_assign, r.spans) for r in secrets.listing(twice).collect()] == [(1, "assign:0:18")] * 2
    out = secrets.scan(twice)
    assert sorted(out.columns) == sorted([*twice.columns]) and {r.spans for r in out.collect()} == {"x"}


# --- 3, 10: learned ------------------------------------------------------------------------------------------------------
def longest_phrases(source, codes):
    """The number of phrases by trying every length."""
    text, held = "".join(map(chr, codes)), "".join(map(chr, source))
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in held:
            size += 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize("window, few", [(3, 0), (16, 5), (512, 48), (512, 100_000)])
def test_phrases(monkeypatch, window, few):
    monkeypatch.setattr(langid, "WINDOW", window)
    monkeypatch.setattr(langid, "FEW", few)
    samples = {
        "a": "abracadabra", "b": "zzz", "c": "солнце светит ярко над морем", "d": "日本語の文章は漢字と仮名で書かれる。日本は島国である",
        "e": "ο ήλιος λάμπει πάνω από τη θάλασσα", "f": "abcabcabcabdabcabd" * 20,
    }
    model = langid.Model(samples)
    sources = [model.encode(samples[k]).tolist() for k in model.languages]
    draw = random.Random(3)
    texts = ["".join(draw.choice(s) for _ in range(draw.randint(1, 60))) for s in ["abrcdz", "abcd", "солнце я", "日本語文章は漢。x", "ο λάμπήx日"] * 40]
    texts += ["".join(draw.choice(list(samples.values()))[draw.randint(0, 9) :] for _ in range(n)) for n in (60, 200, 400)]
    texts += ["abc" * 2000, "z" * 3000, samples["f"] * 8, "İSTANBUL ǅ 😀 ΟΔΟΣ", "x" * 1000 + "abracadabra" * 100]
    codes = [model.encode(t) for t in texts]
    got = model.phrases(codes)
    for i, own in enumerate(codes):
        assert got[i].tolist() == [longest_phrases(s, own.tolist()) for s in sources], texts[i][:40]


def test_scripts_apart():
    """Letters of every script count, however many there are."""
    draw = random.Random(8)
    alphabets = {"zh": range(0x4E00, 0x4E00 + 900), "ja": range(0x3041, 0x3090), "ru": range(0x430, 0x450), "el": range(0x3B1, 0x3C9), "en": range(97, 123)}
    words = {k: ["".join(chr(draw.choice(a)) for _ in range(draw.randint(1, 6))) for _ in range(400)] for k, a in alphabets.items()}
    model = langid.Model({k: " ".join(draw.choice(w) for _ in range(2000)) for k, w in words.items()})
    texts = [" ".join(draw.choice(w) for _ in range(30)) for w in words.values() for _ in range(20)]
    assert model.predict(texts)[0] == [k for k in words for _ in range(20)]


def test_learning_rows(spark):
    rows = [(i, f"text {i} " + "ab " * 20, "x") for i in range(300)] + [(1000, "same " * 30, "x")] * 50 + [(2000 + i, "long " * 40, "y") for i in range(3)] + [(None, "none", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.sample_texts(frame, "text", "lang", "doc_id", train_docs=30, train_chars=180)
    assert sample["y"] == "long " * 40  # no shorter one: the shortest, whole
    whole = {t for _, t, _ in rows}
    assert 1 <= len(sample["x"].split("\n")) <= 3 and set(sample["x"].split("\n")) <= whole and "none" not in sample["x"]
    out = langid.predictions(frame).filter("doc_id IS NULL").collect()
    assert [r.held_out for r in out] == [False]


def test_language(spark, small):
    out = langid.predictions(table(spark, small, "documents")).join(table(spark, small, "documents").select("doc_id", "lang"), "doc_id")
    assert out.filter("held_out and lang = lang_pred").count() >= 0.95 * out.filter("held_out").count()
    row = langid.identify(docs(spark, [None, "", "12 .", "the"]), {"en": "the cat"}).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score) for r in row[:3]] == [("und", 0.0)] * 3 and row[3].lang_pred == "en"
    assert {r.lang_pred for r in langid.predictions(docs(spark, ["abc"])).collect()} == {"und"}
    assert langid.predictions(docs(spark, ["a"]).limit(0)).count() == 0
    assert langid.keep_identified(docs(spark, ["a", "1"])).columns == [c.split()[0] for c in DOCS.split(", ")]


def test_quality(spark, small):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    out = quality.predictions(table(spark, "/root/testdata/sf0.01", "documents"), labels).join(labels, "doc_id").filter("held_out")
    assert out.filter("predicted = quality").count() >= 0.9 * out.count()
    assert quality.fit([], []).score(np.zeros(0, np.int32)) == 0.5
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.predictions(docs(spark, EDGE), empty).collect()} == {0.5}


def test_fit_by_its_objective():
    """Log-count ratios by counting, and a primal objective that the dual one meets."""
    draw = np.random.default_rng(2)
    rows = [np.unique(draw.integers(0, 40, draw.integers(1, 12))).astype(np.int32) for _ in range(80)]
    labels = [int(len(set(r.tolist()) & {1, 2, 3, 4, 5}) + draw.integers(0, 2) > 1) for r in rows]
    cost, bits = 0.5, 6
    model = quality.fit(rows, labels, bits=bits, epochs=4000, cost=cost)
    counts = np.ones((2, 1 << bits))
    for r, y in zip(rows, labels, strict=True):
        for x in r:
            counts[y, x] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    w = np.divide(model.weights, ratio, out=np.zeros(1 << bits), where=ratio != 0)
    x = np.zeros((80, 1 << bits))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(len(r))
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    caps = np.where(y > 0, cost * 80 / (2 * (y > 0).sum()), cost * 80 / (2 * (y < 0).sum()))

    def primal(weights, bias):
        return 0.5 * (weights @ weights + bias * bias) + (caps * np.maximum(0, 1 - y * (x @ weights + bias))).sum()

    best = primal(w, model.bias)
    for _ in range(300):  # no step to any side gets lower
        step = draw.standard_normal((1 << bits) + 1) * 10.0 ** -draw.integers(1, 4)
        assert primal(w + step[:-1], model.bias + step[-1]) >= best - 1e-6


# --- 4: near duplicates --------------------------------------------------------------------------------------------------
def brute_components(texts):
    def items(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [items(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def family(n, edits, seed=1):
    draw = random.Random(seed)
    base = [f"w{draw.randint(0, 400)}" for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"e{draw.randint(0, 9999)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("blocks", [False, True])
def test_near_duplicates(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(neardup, "SMALL", 3)
        monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 8)
        monkeypatch.setattr(neardup, "STAR_ROUNDS", 1)
    texts = [*EDGE, *EDGE, *family(40, 12), *family(20, 3, 2), "One two", "one  TWO"]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.groups(docs(spark, texts)).collect()}
    for i, (size, component) in enumerate(brute_components(texts)):
        assert got[i] == (size, component, i == component)


def test_near_duplicates_empty(spark):
    assert neardup.groups(docs(spark, ["a"]).limit(0)).count() == 0
    assert neardup.keep_one(docs(spark, ["a b", "a b", None])).count() == 2


def test_components(spark):
    draw = random.Random(9)
    links = [(i, i + 1) for i in range(40)] + [(100 + draw.randint(0, 60), 100 + draw.randint(0, 60)) for _ in range(40)]
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)


# --- 5: shards -----------------------------------------------------------------------------------------------------------
def test_shards(spark, small):
    out = sharding.shards(table(spark, "/root/testdata/sf0.01", "documents")).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 2 * out["size"].max()
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard")["slot"])
    assert len(out) == 1000
    few = sharding.shards(docs(spark, [None, "", "a", "a"])).toPandas()
    assert sorted(few["size"]) == [8, 8, 9, 9] and few[few["size"] == 8]["text_crc32"].tolist() == [0, 0]
    assert sharding.shards(docs(spark, ["a"]).limit(0)).count() == 0


def test_tree(spark, monkeypatch, shards=7):
    """The same shards as by sorting every node's points and cutting at the weighted median."""
    monkeypatch.setattr(sharding, "FINE", 0.0)
    draw = random.Random(shards)
    texts = ["word " * draw.randint(0, 60) + str(draw.randint(0, 150)) for _ in range(400)] + ["copy " * 30] * 60 + [None, "", ""]
    rows = [(i, t, draw.choice(["a", "b", None]), draw.choice("pqrst"), 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS)
    source = sharding._rows(frame).select("*", F.xxhash64("doc_id").alias("h")).collect()
    groups: dict = {}
    for r in source:
        g = groups.setdefault(r["group"], {"bytes": 0, "size": 0, "source": [], "lang": []})
        g["bytes"] += r["size"]
        g["size"] = max(g["size"], r["size"])
        g["source"] += [r["source"]] * (r["source"] is not None)
        g["lang"] += [r["lang"]] * (r["lang"] is not None)
    share = max(1.0, sum(g["bytes"] for g in groups.values()) / shards)
    hashed = {r.v: r.h % (1 << 15) for r in spark.createDataFrame([(v,) for v in ["a", "b", "p", "q", "r", "s", "t"]], "v string").select("v", F.xxhash64("v").alias("h")).collect()}
    hashed[None] = spark.range(1).select(F.xxhash64(F.lit(None).cast("string"))).head()[0] % (1 << 15)
    points, name_of = {}, {}
    for r in source:
        g = groups[r["group"]]
        pieces = math.ceil(g["bytes"] / (sharding.PIECE * share)) if g["bytes"] > sharding.PIECE * share else 1
        name = r["group"], r["h"] % min(pieces, 4095)
        name_of[r["doc_id"]] = name
        tie = ((r["group"] % (1 << 64)) >> 29 << 12) + name[1]
        q = {"size": min((1 << 15) - 1, int(math.log2(g["size"]) * 800)), "source": hashed[min(g["source"], default=None)], "lang": hashed[min(g["lang"], default=None)]}
        p = points.setdefault(name, {"name": name, "bytes": 0, **{f"q_{x}": v for x, v in q.items()}, **{f"k_{x}": (v << 47) + tie for x, v in q.items()}})
        p["bytes"] += r["size"]
    want = plain.shards(list(points.values()), shards)
    got = {r.doc_id: r.shard for r in sharding.assign(frame, shards).collect()}
    assert got == {i: want[n] for i, n in name_of.items()}
    assert dict(sharding.shards(frame).dtypes)["slot"] == "bigint"


def test_hot_group_is_divided(spark):
    texts = ["same text " * 50] * 400 + [f"text {i} " * 60 for i in range(800)]
    sizes = sharding.shards(docs(spark, texts)).groupBy("shard").agg(F.sum("size").alias("n")).toPandas()["n"]
    assert sizes.max() < 1.1 * sizes.min()


# --- 6, 7: decontamination, lines -----------------------------------------------------------------------------------------
QUESTION = "A farmer sells 12 apples to Maria for 30 cents and then 12 pears to Peter for 45 cents, so how much money does Maria pay?"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, QUESTION), (2, "short item"), (3, None), (4, "")], "item_id long, text string")
    changed = QUESTION.replace("12", "17").replace("Maria", "Julia").replace("30", "90")
    broken = changed.replace("to Julia", "to Otto").replace("17 pears", "18 pears")
    texts = [*EDGE, "Intro words. " + QUESTION + " More.", changed, broken, "here is a short item indeed", "clean words " * 30]
    n = len(EDGE)
    got = {(r.doc_id, r.item_id) for r in decontaminate.listing(docs(spark, texts), bench).collect()}
    assert got == {(n, 1), (n + 1, 1), (n + 3, 2)}
    assert decontaminate.keep_clean(docs(spark, texts), bench).count() == len(texts) - 3
    assert decontaminate.listing(docs(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.listing(docs(spark, texts).limit(0), bench).count() == 0


def test_decontamination_of_long_texts(spark):
    bench = spark.createDataFrame([(1, QUESTION), (2, "1, 2, 3, 4, 5 and 6 apples")], "item_id long, text string")
    texts = ["1," * 500_000, "12.5 km, " * 100_000, "1 " * 200_000 + QUESTION + " 2" * 200_000, "Anna " * 100_000, "a#b~c@d " * 50_000]
    began = time.monotonic()
    got = {(r.doc_id, r.item_id) for r in decontaminate.listing(docs(spark, texts), bench).collect()}
    assert got == {(2, 1)} and time.monotonic() - began < 90


def test_decontamination_of_a_later_place(spark):
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    before = "A farmer sells 99 apples to Otto for 11 cents and then 55 pears to Bruno for 77 cents. These are other words. "
    texts = [before + QUESTION, QUESTION + " " + before, before * 3 + QUESTION.replace("and then", "and only then")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.listing(docs(spark, texts), bench).collect()}
    assert got == {(0, 1), (1, 1), (2, 1)}


def test_decontamination_of_edits_and_excerpts(spark):
    draw = random.Random(21)
    short, long, edge = lines_of(draw, 1, 15), lines_of(draw, 1, 100), lines_of(draw, 1, 26)
    bench = spark.createDataFrame([(1, short), (2, long), (3, edge)], "item_id long, text string")

    def changed(text, *places):
        return " ".join("other" if i in places else w for i, w in enumerate(text.split()))

    around = lines_of(draw, 1, 40)
    bodies = [changed(short, 7), " ".join(long.split()[30:60]), changed(edge, 8, 17), " ".join(long.split()[:15]), changed(long, *range(0, 100, 7))]
    texts = [f"{around} {b} {around}" for b in bodies]
    got = {(r.doc_id, r.item_id) for r in decontaminate.listing(docs(spark, texts), bench).collect()}
    assert got == {(0, 1), (1, 2), (2, 3)}


def test_decontamination_by_loops(spark):
    """Every pair's windows, alignments and slots gone through one by one."""
    draw = random.Random(31)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    names = "Anna Peter Julia Otto Maria".split()

    def word():
        x = draw.random()
        return str(draw.randint(1, 99)) + draw.choice([" km", " apples", ""]) if x < 0.12 else draw.choice(names) if x < 0.2 else draw.choice(vocabulary)

    def words(n):
        return " ".join(word() for _ in range(n))

    def edited(text):
        out = text.split()
        for _ in range(draw.choice([0, 0, 1, 3, 8])):
            i = draw.randrange(len(out))
            out[i : i + 1] = draw.choice([[word()], [], [out[i], word()]])
        if draw.random() < 0.5:
            swap = {n: draw.choice(names) for n in names} | {str(i): str(draw.randint(1, 99)) for i in range(100)}
            out = [swap.get(w, w) for w in out]
        lo = draw.choice([0, 0, len(out) // 3])
        return " ".join(out[lo:])

    items = {i: words(n) for i, n in enumerate([3, 6, 10, 20, 30, 47, 48, 60, 90, 10])} | {20: None, 21: ""}
    texts = [words(draw.randint(0, 40)) + " " + " and ".join(edited(draw.choice([x for x in items.values() if x])) for _ in range(draw.randint(0, 2))) + " " + words(draw.randint(0, 30)) for _ in range(120)]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.listing(docs(spark, texts), bench).collect()}
    want = plain.contaminated(dict(enumerate(texts)), items)
    assert got == want and 30 < len(want) < 400


def test_lines_by_loops(spark):
    """Templates as tuples, all holders compared with one another."""
    draw = random.Random(17)
    forms = ["Posted by {} in Travel", "Back to {} news today", "Page {} of 12", "{} {}", "Copyright 2001 {} and all the rights are reserved by the owners of these {} pages",
             "read {} more about this and about many other things of the same kind on our {} site", "\x0b\t ", "", "a\u00a0b {}"]
    names = "Anna Peter Julia Otto Maria Clara Bruno 12 x@y.z http://a".split()
    texts = []
    for _ in range(60):
        lines = lines_of(draw, draw.randint(1, 6), 9).split("\n")
        lines += [draw.choice(forms).format(draw.choice(names), draw.choice(names)) for _ in range(draw.randint(0, 4))]
        draw.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [texts[3]] * 4 + [texts[5] + "\nmore"] * 3 + [None, "", "\n\n", "12 of 12"]
    draw.shuffle(texts)
    want = plain.dropped_lines(texts)
    for rows in (line_dedup.BROADCAST_ROWS, -1):
        got = {r.doc_id: r.dropped for r in line_dedup.drop_lines(docs(spark, texts), broadcast_rows=rows).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert sum(map(len, want)) > 20


def test_line_templates():
    draw = random.Random(19)
    lines = [" ".join(draw.choice(["a", "b", "c", "1", "http://x", "d@e"]) for _ in range(draw.choice([0, 1, 3, 6, 11, 12, 15, 40]))) for _ in range(300)]
    hashes, own = line_dedup.Lines(lines).templates()
    for i, line in enumerate(lines):
        assert len(set(hashes[own == i].tolist())) == len(plain.templates(line)) and set(hashes[own == i].tolist()) == set(line_dedup.templates(line))
    same = {}
    for line in lines:
        for h in line_dedup.templates(line):
            same.setdefault(h, set()).add(len(line.split()))
    assert all(len(sizes) == 1 for sizes in same.values())  # the first level of the tree


def test_lines(spark):
    draw = random.Random(4)

    def prose():
        return " ".join(f"p{''.join(draw.choice('abcdefgh') for _ in range(6))}" for _ in range(40))

    notice = "Copyright 20{} by the publisher of these pages and all rights are reserved here"
    copy = "\n".join(prose() for _ in range(3))
    texts = [prose() + "\n" + notice.format(i) + "\n\n" + prose() for i in range(8)] + [copy] * 30 + EDGE + ["\n" + notice.format(9)]
    out = {r.doc_id: r for r in line_dedup.drop_lines(docs(spark, texts)).collect()}
    assert all(out[i].dropped == [1] and "Copyright" not in out[i].text for i in range(8))
    assert all(out[i].dropped == [] and out[i].text == copy for i in range(8, 38))
    shuffled = {r.doc_id: r for r in line_dedup.drop_lines(docs(spark, texts), broadcast_rows=-1).collect()}
    assert shuffled == out
    assert line_dedup.strip_recurring(docs(spark, texts)).filter(F.col("doc_id") == len(texts) - 1).count() == 0
    assert line_dedup.listing(docs(spark, texts).limit(0)).count() == 0


def lines_of(draw, n, words=12):
    return "\n".join(" ".join("".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(words)) for _ in range(n))


@pytest.mark.parametrize("rows", [line_dedup.BROADCAST_ROWS, -1])
def test_lines_beside_copies(spark, rows):
    draw = random.Random(11)
    licence = "this text is given under the terms of the open licence"
    copy = lines_of(draw, 8) + "\n" + licence
    near = []
    for _ in range(150):
        words = copy.split(" ")
        for _ in range(3):
            words[draw.randrange(len(words) - 12)] = f"e{draw.randint(0, 99999)}x"
        near.append(" ".join(words))
    texts = [lines_of(draw, 8) + "\n" + licence for _ in range(8)] + [copy] * 40 + near
    out = line_dedup.drop_lines(docs(spark, texts), broadcast_rows=rows).collect()
    assert all(r.dropped == [r.n_lines - 1] and licence not in r.text for r in out)  # of the copies no other line
    kept = line_dedup.drop_lines(docs(spark, [copy] * 40 + near), broadcast_rows=rows).collect()
    assert all(r.dropped == [] for r in kept)


def test_long_lines_in_short_documents(spark):
    draw = random.Random(12)
    notice = lines_of(draw, 1, 60)
    texts = [f"{notice}\n{lines_of(draw, 1, n)}" for n in (30, 30, 10, 10, 5, 5, 2, 1)] + [notice] * 3
    out = {r.doc_id: r.dropped for r in line_dedup.drop_lines(docs(spark, texts)).collect()}
    assert all(out[i] == [0] for i in range(len(texts)))
    alone = line_dedup.drop_lines(docs(spark, [notice + " " * i for i in range(20)])).collect()
    assert all(r.dropped == [] for r in alone)  # texts of nothing else are copies


def test_word_fields(spark):
    draw = random.Random(13)
    names = "Anna Peter Julia Otto Maria Clara Bruno".split()
    forms = [
        "Posted by {} in Travel",
        "Back to {} news",
        "{} wrote this page here",
        "{} is the editor of these pages and holds all rights to every text",
        "All the pages of {} are free to read and may be copied by {} at any time",
    ]
    texts = ["\n".join([lines_of(draw, 10), *(f.format(n, names[-1 - i]) for f in forms)]) for i, n in enumerate(names)]
    short = [lines_of(draw, 10) + f"\n12 of {w}\n{w}\n{w} 7 8 9" for w in names]
    out = {r.doc_id: r.dropped for r in line_dedup.drop_lines(docs(spark, texts + short)).collect()}
    assert all(out[i] == [10, 11, 12, 13, 14] for i in range(len(texts)))
    assert all(out[i] == [] for i in range(len(texts), len(out)))  # too little of these is constant


# --- 8: neighbours ---------------------------------------------------------------------------------------------------------
def exact(ids, vectors, query, k=20):
    score = vectors @ vectors[query]
    order = [i for i in np.lexsort((ids, -score)) if i != query][:k]
    return [int(ids[i]) for i in order]


@pytest.mark.parametrize("limit", [ann.BROADCAST_BYTES, 0])
def test_neighbours(spark, limit):
    draw = np.random.default_rng(1)
    vectors = draw.standard_normal((700, 12)) * draw.uniform(0.5, 2, (700, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (920, [0.0] * 12), (940, [float("nan")] * 12), (960, [1.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("node") % 20 == 0, broadcast_bytes=limit).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got) == list(range(0, 700, 20))
    hits = sum(len(set(exact(np.arange(700), vectors, q)) & set(v)) for q, v in got.items())
    assert hits >= 0.9 * 20 * len(got)
    assert all(abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-9 for r in out)


def test_crowds_of_equal_vectors(spark):
    draw = np.random.default_rng(4)
    crowd, other = draw.standard_normal(8), draw.standard_normal((300, 8)) * draw.uniform(0.2, 3, (300, 1))
    vectors = np.concatenate([np.repeat(crowd[None], 500, axis=0), other, np.repeat(other[:3], 30, axis=0), np.array([[0.0, -0.0, 1, 0, 0, 0, 0, 0], [-0.0, 0.0, 1, 0, 0, 0, 0, 0]])])
    ids = np.random.default_rng(5).permutation(len(vectors))
    out = ann.listing(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    order = np.argsort(ids)
    assert sorted(got) == list(range(0, len(ids), 20))
    same = [found == exact(np.arange(len(ids)), vectors[order], q) for q, found in got.items()]
    assert np.mean(same) >= 0.95


def test_few_neighbours(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    out = ann.listing(rows).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5)]
    assert ann.listing(rows.limit(0)).count() == 0
    assert ann.listing(rows.limit(1)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------------
def test_pipeline(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "byte_bpe"]
    source = table(spark, small, "documents")
    frame = source
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = materialize(stage(spark, frame, small), "stage")
        assert frame.columns == source.columns
    kept = {r.doc_id for r in frame.collect()}
    out = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in out} == kept and all(r.round_trip for r in out)
    assert 0 < len(kept) < source.count()


def test_pipeline_by_loops(spark, tmp_path):
    """Every stage's plain version on a small table, one after the other."""
    import corpus_pipeline

    draw = random.Random(23)
    items = {1: "Anna walks 12 km to the old market and buys 3 apples for 20 cents before she meets Otto at the river", 2: lines_of(draw, 1, 60)}
    texts = [lines_of(draw, draw.randint(2, 5), 14) for _ in range(50)]
    texts = [t + "\nPosted by Anna in Travel" if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += [texts[7]] * 3 + [texts[8].replace("a", "A", 1)] * 2 + [texts[9] + " more words here"] + [texts[10] + " " + items[1], items[2].replace(" ", "  "), "Posted by Anna in Travel"]
    texts += [None, "", "12 34", " ", "one two", "One  two"]
    rows = [(i, t, draw.choice(["en", "de"]), "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    gone = dict(zip(left, plain.dropped_lines(list(left.values())), strict=True))
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in left.items()}
    left = {i: t for i, t in cut.items() if not gone[i] or t.strip()}
    named = brute_components(list(left.values()))
    ids = list(left)
    left = {i: t for n, (i, t) in enumerate(left.items()) if ids[named[n][1]] == i}
    dirty = {i for i, _ in plain.contaminated(left, items)}
    left = {i: t for i, t in left.items() if i not in dirty}

    tool = bpe.codec()._library
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id: r.ids_sha256 for r in out} == {i: hashlib.sha256(" ".join(map(str, tool.encode_ordinary(t))).encode()).hexdigest() for i, t in left.items()}
    assert 40 < len(out) < len(texts) and len(dirty) == 2


# --- shapes that every operator takes ---------------------------------------------------------------------------------------
def listings(spark, frame):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    yield "op1", bpe.digests(frame)
    yield "op2", secrets.listing(frame)
    yield "op3", langid.predictions(frame)
    yield "op4", neardup.groups(frame)
    yield "op5", sharding.shards(frame)
    yield "op6", decontaminate.listing(frame, bench)
    yield "op7", line_dedup.listing(frame)
    yield "op9", token_counts.lengths(frame)
    yield "op10", quality.predictions(frame, labels)


CLASHING = "n_tokens ids decoded secret_spans spans lang_pred score held_out n_shingles component_id kept size shard slot law n_windows dropped n_lines over_limit predicted text_sha256 node".split()


def test_clashing_and_empty(spark):
    texts = [f"some words of text {i} and token=abcdefghijkl\nline" for i in range(8)]
    frame = docs(spark, texts)
    more = frame.withColumns({c: F.lit("clash") for c in CLASHING})
    plainly = {name: out for name, out in listings(spark, frame)}
    for name, out in listings(spark, more):
        assert out.dtypes == plainly[name].dtypes, name
        assert sorted(map(str, out.collect())) == sorted(map(str, plainly[name].collect())), name
    for name, out in listings(spark, more.limit(0)):
        assert out.dtypes == plainly[name].dtypes and out.count() == 0, name


def test_repeated_and_lost_ids(spark):
    texts = ["some words of a text", None, "", "other words"]
    frame = docs(spark, texts)
    twice = frame.union(frame).union(frame.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = {name: out.count() for name, out in listings(spark, twice)}
    assert rows == {"op1": 9, "op2": 9, "op3": 9, "op4": 5, "op5": 9, "op6": 0, "op7": 9, "op9": 9, "op10": 9}


def test_names():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES}) == list(range(1, 11))
