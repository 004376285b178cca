import hashlib
import itertools
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gaussframe.llm import byte_bpe, exact_dedup, licenses, matroska, mixing, ngram_join, pii, quality, toxicity, token_counts

SCHEMA = "doc_id long, text string, source string, n long, c0 string"
LONG = "some words that go on " * 3000
BASE = " ".join(f"w{i}" for i in range(300))
TEXTS = [None, "", "  \t\n", "a", "a b", "Hello  world", "Hello world", "Hello\tworld", "héllo 漢字 😀 " * 5, LONG, LONG, BASE, BASE.replace("w150", "zz"), BASE.replace("w7 ", "q ").replace("w200", "y"), "bob@mail.example.com +1 (743) 555-3824 8.196.197.208 4111 1111 1111 1111", "<s> <unk> it's  done ", "1" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, 1, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "Hello world", "s0", None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def base_spans(x):
    out = []
    for k, r in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(r, x):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if k == "ip" and any(int(p) > 255 for p in m.group().split(".")) or k == "card" and not (16 <= len(d) <= 19 and luhn) or k == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_pii_base_and_added(spark, docs):
    more = ["a@b.c_d@e.f x@y.z.w 300.1.1.1 1.2.3.4.5.6.7.8", "é😀 a@b.co", "1-" * 3000, "a@b." * 300]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    for r in pii.find_pii(df).select("text", pii.joined(F.col("__base")).alias("b"), pii.joined(F.col("__spans")).alias("s")).collect():
        assert r.b == ",".join(base_spans(r.text or ""))
        assert set(r.b.split(",")) <= set(r.s.split(",")) | {""}
    made = spark.createDataFrame([(1, "call (743) 555-3824 now"), (2, "order 743-555-3824"), (3, "bob [at] example [dot] com")], "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find_pii(made).select("doc_id", pii.joined(F.col("__spans")).alias("s")).collect()}
    assert got == {1: "phone:5:19", 2: "", 3: "email:0:26"}
    # other columns stay, whatever their names, and redaction keeps lengths
    odd = spark.createDataFrame([(1, "é a@b.co x", 7), (2, None, 8), (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e"', 9)], "base int, text string, wide int")
    assert [tuple(r) for r in pii.redact(odd).orderBy("base").collect()] == [(1, "é ██████ x", 7), (2, None, 8), (3, "█" * 41 + '"', 9)]
    with pytest.raises(ValueError):
        pii.find_pii(odd.withColumn("__base", F.lit(1)))


def test_pii_recall_of_planted_spans(spark):
    """Sentences of the training rule with another seed: most planted spans are found, few others are."""
    rows = pii._made(500, seed=5)
    df = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    found = {r.doc_id: [(c.s, c.e) for c in r["__spans"]] for r in pii.find_pii(df).collect()}
    planted = [(i, s, e) for i, _, s, e in rows if s >= 0]
    hits = sum(any(min(e, y) - max(s, x) >= 0.8 * (e - s) for x, y in found[i]) for i, s, e in planted)
    false = sum(bool(found[i]) for i, _, s, _ in rows if s < 0)
    assert hits >= 0.7 * len(planted) and false <= 0.1 * (len(rows) - len(planted)), (hits, len(planted), false)


def test_pii_many_matches(spark):
    df = spark.createDataFrame([(1, "u1@example.com, " * 20_000)], "doc_id long, text string")
    t = time.time()
    r = pii.find_pii(df).select(F.size("__base").alias("b"), F.element_at("__base", -1).alias("l")).first()
    assert r.b == 20_000 and (r.l.s, r.l.e) == (16 * 19_999, 16 * 19_999 + 14) and time.time() - t < 90


def test_exact_dedup(docs, none):
    rows = exact_dedup.exact_groups(docs, digests=True).collect()
    assert len(rows) == docs.count()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for r in docs.collect():
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    for r in rows:
        own = [g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256][0]
        assert r.group_size == len(own) and r.keep_id == min((x for x in own if x is not None), default=None)
    assert sum(r.kept for r in rows) == len(groups) and texts
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(norm(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.keep_one(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 64, 511, 512, 513, 4096, 5000, 200_000])
def test_matroska_round_trip(n):
    data = matroska.pad(bytes(i * 7 % 256 for i in range(n)))
    file = matroska.mux(data)
    found, cues, tracks = matroska.packets(file)
    assert matroska.read_back(file) == data and len(cues) == found[-1].cluster + 1 and tracks[1]["codec"].startswith("A_PCM")


@pytest.mark.parametrize("kind", [matroska.XIPH, matroska.EBML_LACING])
def test_matroska_lacing(kind):
    frames = [bytes([i]) * n for i, n in enumerate((3, 700, 1, 255, 256, 9))]
    body = matroska.lace_bytes(kind, frames)
    assert [body[a:b] for a, b in matroska.frames_of(body, 0, len(body), kind)] == frames


def test_matroska_features(docs):
    for r in matroska.media_features(docs.join(docs.select("doc_id").distinct(), "doc_id")).collect():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes)
    with pytest.raises(ValueError):
        matroska.packets(b"not a file")
    df = docs.limit(1).select(F.lit(1).alias("k"), F.lit(bytearray(matroska.mux(b"x" * 640))).alias("m"))
    assert matroska.packet_table(df, "m", "k").count() == 2


def test_matroska_scale_groups_and_unknown_sizes(spark, none):
    m = matroska
    head = m.element(m.EBML, m.element(m.DOC_TYPE, b"matroska"))
    info = m.element(m.INFO, m.uint(m.TIMESTAMP_SCALE, 2_000_000))
    body = b"\x81" + (5).to_bytes(2, "big") + b"\x00" + b"abc"
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, body))
    refers = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, body) + m.element(m.REFERENCE_BLOCK, b"\xff"))
    # a cluster of unknown size, then tags that it must not swallow
    cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + m.uint(m.TIMESTAMP, 10) + group + refers
    file = head + m.element(m.SEGMENT, info + cluster + m.element(m.TAGS, b"\xec\x81x") + m.element(m.CLUSTER, m.uint(m.TIMESTAMP, 20) + group))
    found, _, _ = m.packets(file)
    assert [(p.timestamp, p.keyframe, p.cluster, file[p.start : p.end]) for p in found] == [(30, True, 0, b"abc"), (30, False, 0, b"abc"), (50, True, 1, b"abc")]
    df = spark.createDataFrame([(1, bytearray(file)), (2, bytearray(file[:-4])), (3, None)], "k int, m binary")
    rows = m.packet_table(df, "m", "k").collect()
    assert [(r.k, r.packet) for r in sorted(rows, key=lambda r: (r.k, r.packet or 0))] == [(1, 0), (1, 1), (1, 2), (2, None)]
    assert [r.k for r in rows if r.error] == [2] and m.media_features(none).count() == 0


def test_matroska_columns_are_the_payloads(spark):
    for r in matroska.media_features(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")).collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(matroska.mux(padded)).hexdigest()


def test_toxicity_scores_are_the_kernel_machine():
    """The table of triples scores words as a naive sum over shared subsequences does."""
    def naive(word, weights):
        total = 0.0
        for i in range(len(word)):
            for k in range(i + 2, min(len(word), i + toxicity.SPAN)):
                for j in range(i + 1, k):
                    c = [int(toxicity._codes()[ord(x)]) for x in (word[i], word[j], word[k])]
                    total += weights[(c[0] * 64 + c[1]) * 64 + c[2]] * toxicity.DECAY ** (k - i - 2)
        return total / toxicity._norms([word])[0]

    w = np.random.default_rng(0).normal(size=64**3)
    words = ["^idiot$", "^id$", "^quiet", "river$"]
    assert np.allclose(toxicity.Scorer(w, 0.5, np.zeros(3)).words(words), [naive(x, w) + 0.5 for x in words])


def test_quality_is_a_sum_of_bins():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, len(quality.FEATURES)))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (r.random(400) < 0.05)).astype(float)
    gam = quality.fit(x, y)
    rows = x[:20]
    want = []
    for row in rows:
        z = gam.base + sum(t[int((e < v).sum())] for t, e, v in zip(gam.tables, gam.edges, row))
        z += sum(t[int((gam.pair_edges[i] < row[i]).sum()), int((gam.pair_edges[j] < row[j]).sum())] for i, j, t in gam.pairs)
        want.append(1 / (1 + np.exp(-z)))
    assert np.allclose(gam.scores(rows), want) and (1, 0) in {(i, j) for i, j, _ in gam.pairs}
    # a pair's tree has rectangles as leaves
    table, _ = quality._shallow_pair(r.normal(size=(6, 6)), np.ones((6, 6)))
    assert len(np.unique(table)) <= quality.LEAVES


def test_tables_without_rows(spark, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.toxicity(none, labels).count() == 0 and quality.quality(none, labels).count() == 0 and pii.find_pii(none).count() == 0
    one = spark.createDataFrame([(1, None), (None, LONG), (1, "a")], "doc_id long, text string")
    clash = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    assert [r.score for r in toxicity.toxicity(one, clash).collect()] == [0.0] * 3 == [r.score for r in quality.quality(one, clash).collect()]


def test_toxicity_gaps():
    # both classes share all but the insults
    rest = "you are such a friend by the quiet river and the trees of house number"
    good = [f"{rest} {i}" for i in range(200)]
    bad = [f"{rest} {i} {'idiot' if i % 2 else 'moron'}" for i in range(200)]
    s = toxicity.fit(good + bad, [0] * 200 + [1] * 200)
    got = s.documents([f"{rest} id-iot", f"{rest} m o r o n", f"{rest} iddiot", rest, None, ""])
    assert min(got[:3]) > max(got[3:]) and min(got[:2]) > 0.5 and max(got[3:]) < 0.5


def test_toxicity_one_class_and_none():
    assert toxicity.fit(["a b"], [1]).documents(["x", None]).tolist() == [1.0, 1.0]
    assert toxicity.fit([], []).documents(["x"]).tolist() == [0.0]


@pytest.mark.parametrize(("name", "column", "mod", "held"), [("op4_toxicity", "toxic", 5, 0), ("op5_quality_gam", "quality", 3, 1)])
def test_held_out_accuracy(spark, name, column, mod, held):
    d = "/root/testdata/sf0.01"
    got = entry.queries()[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % mod == held for i in got.doc_id]).all()
    x = got[got.held_out]
    assert (x.predicted == x[column]).mean() > max(x[column].mean(), 1 - x[column].mean()) + 0.02 and x.score.between(0, 1).all()


def test_licenses(spark, docs, none):
    own = licenses.templates()
    text = "İx some words. Released under the MIT License. more words\nReleased under the MIT License."
    found = licenses.scan_text(text, own)
    assert [(f[0], text[f[2] : f[3]]) for f in found] == [("MIT", "Released under the MIT License")] * 2
    mit = max((n.text for n in licenses.NOTICES if n.license == "MIT"), key=len)
    whole = licenses.scan_text("x " + mit.replace("sublicense", "sub license") + " y", own)
    assert whole[0][0] == "MIT" and 0.95 < whole[0][1] < 1
    assert licenses.scan_text(None, own) == [] and licenses.scan_text("the license of the work", own) == []
    got = licenses.scan(docs.withColumn("matches", F.lit(1))).collect()
    assert len(got) == docs.count() and licenses.scan(none).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Released under the Apache license.", None),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
        ("This library is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("Licensed under the Apache License, Version 1.1.", None),
    ],
)
def test_licenses_and_their_kin(text, want):
    assert [f[0] for f in licenses.scan_text(f"some words {text} more words", licenses.templates())] == [want] * (want is not None)


def test_licenses_take_linear_time():
    words = max((n.text for n in licenses.NOTICES if n.license == "MIT"), key=len).split()
    t = time.time()
    assert licenses.scan_text(" ".join(words[::-1] * 1000), licenses.templates()) == [] and time.time() - t < 20


def test_alignment_is_an_increasing_common_subsequence():
    r = np.random.default_rng(2)
    for _ in range(300):
        a, b = ([f"w{i}" for i in r.integers(0, 12, n)] for n in r.integers(1, 15, 2))
        got = licenses.align(a, b)
        longest = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                longest[i + 1, j + 1] = longest[i, j] + 1 if x == y else max(longest[i, j + 1], longest[i + 1, j])
        assert all(a[i] == b[j] for i, j in got) and len(got) <= longest[-1, -1]
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_flow_of_overlapping_sources():
    # the shared pattern serves b, which has nothing else
    assert mixing.route([((0,), 100), ((0, 1), 50)], [100, 50]) == [100, 50]
    assert mixing.route([((0,), 10)], [50]) == [20]


def test_capped_shares():
    got = mixing.capped_shares([10, 100, 100], [5, 2, 1], 315, 2)
    assert got[0] == 20 and np.isclose(sum(got), 315) and max(g / s for g, s in zip(got, [10, 100, 100], strict=True)) <= 2


def test_mixing(spark, docs, none):
    d = "/root/testdata/sf0.01"
    got = entry.queries()["op7_source_mixing"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text"), "doc_id").toPandas()
    assert (got["size"] == [len(re.findall("[^\x20\x09-\x0d]+", t)) for t in got.text]).all() and (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source").agg(t=("target", "first"), k=("taken", "sum"), n=("size", "sum"))
    assert (abs(by.t - by.k) <= 0.02 * by.n + 50).all()
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("copies", F.lit(1)))


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op7_source_mixing", "op9_ngram_jaccard"])
def test_query_matches_sql(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df().sort_values("doc_id").reset_index(drop=True)
    got = entry.queries()[name](spark, d).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns) and (got[list(want.columns)] == want).all().all()


def test_mixing_many_sources_is_the_same(spark, docs, monkeypatch):
    d = "/root/testdata/sf0.001"
    key = lambda r: (str(r[0]), *r[1:3], r[4])
    few = [sorted(map(key, mixing.mix_table(x).collect())) for x in (docs, spark.read.parquet(f"{d}/documents.parquet"))]
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1)
    assert few == [sorted(map(key, mixing.mix_table(x).collect())) for x in (docs, spark.read.parquet(f"{d}/documents.parquet"))]
    with pytest.raises(ValueError):
        mixing.mix_table(docs, members=F.array(F.col("source"), F.lit("z")))


def test_flow_is_largest_and_cheapest():
    def best(patterns, quotas):
        subsets = [c for k in range(len(quotas) + 1) for c in itertools.combinations(range(len(quotas)), k)]
        fits = lambda g: all(sum(x for x, (m, _) in zip(g, patterns) if set(m) <= set(c)) <= sum(quotas[s] for s in c) for c in subsets)
        return min((-sum(g), sum(max(0, x - n) for x, (_, n) in zip(g, patterns))) for g in itertools.product(*(range(2 * n + 1) for _, n in patterns)) if fits(g))

    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 3)
        patterns = [(sorted(r.sample(range(n), r.randint(1, n))), r.randint(0, 4)) for _ in range(r.randint(1, 3))]
        quotas = [r.randint(0, 8) for _ in range(n)]
        got = mixing.route(patterns, quotas)
        assert (-sum(got), sum(max(0, x - n) for x, (_, n) in zip(got, patterns))) == best(patterns, quotas)


def test_token_counts(docs, none):
    path = str(P.path("piece_bpe_32k.model"))
    sp = token_counts.model(path)
    odd = docs.select("doc_id", "text").unionByName(docs.select(F.lit(50), F.lit("　 a ▁b  \x00 \n ")).toDF("doc_id", "text"))
    for r in token_counts.count_tokens(odd, path).collect():
        assert r.n_tokens == len(sp.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())
    assert token_counts.count_tokens(none, path).count() == 0


def brute_components(rows, width, num, den):
    sets = []
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = comp[i], comp[j]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    out = []
    for i, (key, _) in enumerate(rows):
        own = [rows[k][0] for k in range(len(rows)) if comp[k] == comp[i] and rows[k][0] is not None]
        out.append((key, len(sets[i]), min(own) if own else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_ngram_join(docs, width, num):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, width=width, num=num).collect()), key=str)
    assert got == brute_components(rows, width, num, 100)


def test_ngram_join_frequent_tokens(spark, monkeypatch):
    r = np.random.default_rng(1)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(80):
        w = list(words)
        for k in r.integers(0, 120, r.integers(0, 5)):
            w[k] = f"x{r.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "FREQUENT", -100)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()), key=str)
    assert got == brute_components(rows, 3, 90, 100)


def test_ngram_join_empty(none):
    assert ngram_join.jaccard_components(none).count() == 0


def test_byte_bpe(spark, docs, none):
    ranks = str(P.path("byte_bpe_50k.tiktoken"))
    enc = byte_bpe.encoder(ranks, P.PATTERN)
    done = byte_bpe.decode(byte_bpe.encode(docs, ranks, P.PATTERN, stable=False), ranks).collect()
    want = sorted((str(r.doc_id), enc.encode_ordinary(r.text or "")) for r in docs.collect())
    assert sorted((str(r.doc_id), np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in done) == want
    assert sorted(bytes(r.decoded).decode() for r in done) == sorted(r.text or "" for r in docs.collect())
    assert byte_bpe.encode(none, ranks, P.PATTERN).count() == 0
    # both ways of decoding agree, and each distinct word is encoded once
    count = spark.sparkContext.accumulator(0)
    both = byte_bpe.encode(docs, ranks, P.PATTERN, stable=False, count=count, round_trip=True).collect()
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in both) == sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in done)
    split = byte_bpe.splitter(P.PATTERN)
    assert count.value == len({w for r in docs.collect() for w in split(r.text or "")})


def stages_after(spark, last):
    """Ids and shuffled bytes of the stages that ran since ``last``."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    empty = sc._jvm.java.util.ArrayList()
    found = sc._jsc.sc().statusStore().stageList(empty, False, False, sc._gateway.new_array(sc._jvm.double, 0), empty)
    every = [(x.stageId(), x.shuffleWriteBytes()) for x in map(found.apply, range(found.size()))]
    return [x for x in every if x[0] > last]


def test_byte_bpe_writes_blocks_once(spark):
    path, ranks = "/root/testdata/sf0.01/documents.parquet", str(P.path("byte_bpe_50k.tiktoken"))
    df = byte_bpe.encode(spark.read.parquet(path), ranks, P.PATTERN, round_trip=True)
    last = max((i for i, _ in stages_after(spark, -1)), default=-1)
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in df.collect()}
    written = sum(b for _, b in stages_after(spark, last))
    # texts are cut once: both sides of the join read one shuffle
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") == 1
    assert 0 < written < 1.4 * os.path.getsize(path)
    enc = byte_bpe.encoder(ranks, P.PATTERN)
    for i, text in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{path}'").fetchall():
        ids = enc.encode_ordinary(text)
        assert got.pop(i) == (len(ids), np.array(ids, "<u4").tobytes(), text.encode())
    assert not got


def test_byte_bpe_words_fill_the_partitions(spark):
    for parts in (1, 4, 211):
        names = byte_bpe.named_parts(spark, parts)
        at = spark.createDataFrame([(n,) for n in names], "n string").select(F.pmod(F.hash("n"), F.lit(parts))).collect()
        assert [r[0] for r in at] == list(range(parts))


def test_byte_bpe_codes_and_bad_ids():
    import pyarrow as pa

    r = np.random.default_rng(3)
    for a in (np.zeros(0, np.uint32), r.integers(0, 300, 999).astype(np.uint32), r.integers(0, 2**20, 99999).astype(np.uint32), np.array([223, 224, 225, 255, 256, 2**25], np.uint32)):
        assert (byte_bpe._decoded(byte_bpe._coded(a)) == a).all()
    tokens = pa.array([b"a", None, b"bc"])
    assert byte_bpe.joined_bytes(pa.array([np.array([2, 0], "<u4").tobytes(), None, b""]), tokens).to_pylist() == [b"bca", None, b""]
    for bad in (1, 3):
        with pytest.raises(ValueError):
            byte_bpe.joined_bytes(pa.array([np.array([bad], "<u4").tobytes()]), tokens)


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "source_mixing", "byte_bpe"]
    got = C.run(spark, d).toPandas()
    assert set(got.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()} and len(got)
    texts = {hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    assert set(got.decoded_sha256) <= texts


@pytest.mark.parametrize(("a", "b"), [(5000, 4900), (5000, 4000), (300, 290), (1100, 1000)])
def test_parity_maps_never_exceed_the_difference(a, b):
    r = np.random.default_rng(a + b)
    s = np.unique(r.integers(0, 2**63, a).astype(np.uint64))
    t = np.unique(np.concatenate([s[: b - 50], r.integers(0, 2**63, 50).astype(np.uint64)]))
    x, y = (ngram_join.parity(v).view(np.uint64) for v in (s, t))
    least = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, least), axis=0) for v in (x, y))
    assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(s, t))


@pytest.mark.parametrize("place", [1, 13, 63])
def test_quality_top_word_counts_every_word(place):
    # the frequent word stands at none of the first places of the text's eighths
    words = [f"w{i}" for i in range(80)]
    words[place : place + 5] = ["Spam", "spam", "SPAM", "spam", "spam"]
    top = quality.FEATURES.index("top_word")
    assert quality.features(" ".join(words))[top] == 5 / 80
    assert quality.features(None)[top] == quality.features(" \n")[top] == 0


def test_pipeline_toxicity_decides_by_row(spark, tmp_path):
    import corpus_pipeline as C

    rest = "you are such a friend by the quiet river and the trees of house number"
    rows = [(i, f"{rest} {i}{' idiot' if i % 2 else ''}") for i in range(400)]
    spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # toxic rows without a key, and clean rows that share a rejected row's key or have none
    more = [(None, f"{rest} x idiot"), (None, f"{rest} y idiot"), (None, f"{rest} z"), (1, f"{rest} one"), (None, None)]
    df = spark.createDataFrame([(i, t, [1], "é") for i, t in rows + more], "doc_id long, text string, more array<int>, `an other` string").withColumn("at", F.lit("2020-01-01").cast("timestamp")).withColumn("s", F.struct(F.lit(1).alias("a")))
    got = C.drop_toxic(spark, df, str(tmp_path))
    assert got.columns == df.columns
    want = sorted([(i, t) for i, t in rows + more if "idiot" not in (t or "")], key=str)
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == want
    assert got.select("more", "an other", "at", "s").distinct().collect() == df.select("more", "an other", "at", "s").distinct().collect()


def test_ngram_keep_one_decides_by_row(spark, none):
    other = " ".join(f"v{i}" for i in range(300))
    lone = " ".join(f"u{i}" for i in range(300))
    # groups: all keys null; a shared smallest key; null beside a key; then rows that stay alone
    rows = [(None, other, "a"), (None, other.replace("v150", "zz"), "b"), (None, other.replace("v7 ", "q "), "c")]
    rows += [(4, BASE, "d"), (4, BASE.replace("w150", "zz"), "e"), (9, BASE.replace("w7 ", "q "), "f"), (None, BASE.replace("w9 ", "q "), "g"), (4, BASE, "h")]
    rows += [(4, lone, "i"), (9, "a b", "j"), (None, None, "k"), (None, " ", "l"), (4, "", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `c 0` string").repartition(3)
    got = ngram_join.keep_one(df)
    kept = {r["c 0"] for r in got.collect()}
    assert got.columns == df.columns and got.count() == len(kept)
    assert len(kept & set("abc")) == 1 and len(kept & set("deh")) == 1 and not kept & set("fg") and set("ijklm") <= kept
    assert ngram_join.keep_one(none).count() == 0
