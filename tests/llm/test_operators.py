"""The ten operators against brute force, round trips and held-out accuracy, with
nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import inspect
import math
import os
import random
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline
from coppice.llm import bpe, langid, licenses, mixing, neardup, queries, resample, rules, tokencount, topk, toxicity
from coppice.llm.graph import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "x" * 3000, "héllo wörld ① ́ 日本語", "<|endoftext|> in text <|endoftext|>", "  two  spaces and　wide ", "word " * 400, "a\x1cb​c ▁ <s>"]


def odd(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "src", None, "extra") for i, t in enumerate(ODD)]
    rows += [rows[3], (None, "no id", "en", "src", 5, "extra"), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC + ", score string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").persist()


def sql(name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con.execute(name).fetchall()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    found = con.execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    canon = lambda r: tuple(f"{v:.10g}" if isinstance(v, float) else v for v in r)
    assert Counter(map(canon, df.select(*columns).collect())) == Counter(map(canon, found.fetchall()))


def test_topk_over_shards_and_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)], 0) for i in range(700)]
    rows += [(None, [1.0] * 4, 0), (800, None, 0), (900, [float("nan")] * 4, 0), (1000, [1.0, 2.0], 0), rows[5], (1100, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in topk.top_k(df, query_every=50, k=3, block=4, components=1024).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v, _ in rows if i is not None and v is not None and all(map(math.isfinite, v))}
    for q, v in sorted(good):
        if q % 50 == 0:
            want = sorted(((sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)), key=lambda x: (-x[0], x[1]))[:3]
            assert got[q] == [(i, s) for s, i in want]
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_of_repeated_ids_and_copies_in_many_waves(spark):
    rng = random.Random(7)
    vector = lambda: tuple(rng.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(4))
    rows = [(i, vector()) for i in range(3000)] + [(7, vector()) for _ in range(300)] + [(50, vector()) for _ in range(300)]
    rows += [(i, (1.0, 1.0, 1.0, 1.0)) for i in range(3000, 4500)] + [(9, (1.0, 0.5, 1.0, 1.0))] * 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in topk.top_k(df, query_every=50, k=4, block=8, components=1024).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    whole = defaultdict(set)
    for i, v in rows:
        whole[i].add(tuple(math.floor(1024 * x) for x in v))
    for q in range(0, 4500, 50):
        v = max(whole[q])
        best = sorted((-max(sum(a * b for a, b in zip(v, w)) for w in vs), i) for i, vs in whole.items() if i != q)[:4]
        assert got[q] == [(i, -s) for s, i in best]


def test_topk_of_products_near_the_end_of_a_long(spark):
    rows = [(0, [2.0**31, 1.0]), (1, [2.0**31, 1.0]), (2, [2.0**31, 2.0]), (3, [-(2.0**31), 0.0]), (4, [2.0**40, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df, query_every=5, k=4, scale=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(4, 2**63 - 1), (2, 2**62 + 2), (1, 2**62 + 1), (3, -(2**62))]


def test_lanes_copy_a_shard_only_as_queries_need():
    assert topk._lanes(0, 1, 16384, 8) == 1
    assert topk._lanes(10_000_000, 30_000, 16384, 1000) == 1
    assert topk._lanes(3 * 10_000_000, 30_000, 16384, 1000) == 1
    assert topk._lanes(513, 2, 16384, 6) == 3
    assert topk._lanes(1_000_000, 2, 16384, 6) == 31


def test_resampling_prefers_the_target(spark):
    good, bad = ["the cat sat on the mat"], ["!!! ### buy now"]
    df = spark.createDataFrame([(i, (good if i < 60 else bad)[0] * (1 + i % 3)) for i in range(100)] + [(200, None), (201, "")], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    out = resample.resample(df, ids, k=50, smoothing=0.01).collect()
    assert sum(r.kept for r in out) == 50 and all(r.doc_id < 60 for r in out if r.kept)
    assert [r.kept for r in out if r.doc_id >= 200] == [False, False]
    assert resample.resample(odd(spark), ids.limit(0), share=1.0).count() == len(ODD) + 3
    assert resample.resample(df.limit(0), ids).count() == 0
    values = spark.createDataFrame([(float(i % 7919),) for i in range(60_000)], "v double")
    assert resample.kth_largest(values, "v", 1000) == sorted((float(i % 7919) for i in range(60_000)), reverse=True)[999]


def test_resampling_by_brute_force(spark, monkeypatch):
    """Weights, noise and cut from plain counts of words, with word ids for buckets."""
    monkeypatch.setattr(resample, "_RUN", 64)
    rng, words = random.Random(2), ["red", "green", "blue", "cyan", "grey"]
    texts = {i: " ".join(rng.choices(words[: 3 + i % 3], k=rng.randrange(0, 12))) for i in range(80)} | {80: None, 81: "", 82: "red " * 500}
    good, buckets, smoothing = set(range(0, 80, 3)), 1 << 14, 0.5
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in good] + [(None,)], "doc_id long")
    grams = {i: Counter(w := (t or "").split()) + Counter(zip(w, w[1:])) for i, t in texts.items()}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        target.update(g if i in good else {})
    share = lambda c, g: math.log((c[g] + smoothing) / (sum(c.values()) + smoothing * buckets))
    weight = {i: sum(n * (share(target, g) - share(raw, g)) for g, n in c.items()) if c else None for i, c in grams.items()}
    out = {r.doc_id: r for r in resample.resample(df, ids, k=20, buckets=buckets, smoothing=smoothing).collect()}
    noise = {r.doc_id: r.u for r in df.select("doc_id", (resample.hashed_unit(df.doc_id, resample.F.lit(1)) + 2.0**-53).alias("u")).collect()}
    key = {i: w - math.log(-math.log(noise[i])) for i, w in weight.items() if w is not None}
    for i, w in weight.items():
        assert (out[i].log_weight is None) if w is None else out[i].log_weight == pytest.approx(w)
    assert {i for i, r in out.items() if r.kept} == set(sorted(key, key=key.get, reverse=True)[:20])


def test_rules_by_brute_force(spark):
    texts = ODD + ["a b c a b c d", "a a a a a", "l1 x\nl1 x\nl2\n \n", "A B C D " * 20, "#$%& " * 60]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    for r in rules.quality(df).collect():
        t = texts[r.doc_id] or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)), t[:40]
    found = [rules.Measured(rules.Rule("slow", F.lit(True)), 10.0, 0.5), rules.Measured(rules.Rule("quick", F.lit(True)), 1.0, 0.4)]
    assert [r.name for r in rules.ordered(found)] == ["quick", "slow"]
    assert rules.quality(df.limit(0)).count() == 0


def test_rules_are_timed_over_raw_text(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", k=3000)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + ODD)], "doc_id long, text string").persist()
    cost = {m.rule.name: m.cost for m in rules.measure(df, rules.production_rules())}
    assert cost["repeated_phrases"] > 2 * cost["few_words"] and cost["repeated_phrases"] > 2 * cost["many_symbols"]
    own = rules.alone()
    apart = df.select("doc_id", *[c.cast("long").alias(k) for k, c in own.items()]).collect()
    assert sorted(apart) == sorted(rules.measures(df).select("doc_id", *own).collect())


def test_mixing_rates_and_ways(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 10, "en", "big" if i % 3 else "small", 10) for i in range(3000)], DOC)
    weights = {"big": 1.0, "small": 3.0}
    out = mixing.mix(df, weights, epochs=2.0)
    n = dict(out.groupBy("source").count().collect())
    assert abs(n["small"] - 4500) < 300 and abs(n["big"] - 1500) < 200
    want = Counter(map(tuple, out.collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter(map(tuple, mixing.mix(df, weights, epochs=2.0).collect())) == want
    many = mixing.mix(df.where("source = 'small'").limit(50), epochs=100.0).count()
    assert abs(many - 5000) < 300
    assert mixing.mix(odd(spark), epochs=3.0).count() > 0 and mixing.mix(df.limit(0)).count() == 0


def test_licenses(spark):
    texts = [f"Some words here.\n{t[0]}\nmore words" for t in licenses.TEMPLATES.values()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, licenses.ORDINARY[0]), (101, None), (102, ""), (103, "plain text of no notice " * 50)]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].licenses for i in range(len(texts))] == [[f] for f in licenses.TEMPLATES]
    assert out[100].licenses == [] and out[100].unknown_notices == 1
    assert [(out[i].licenses, out[i].unknown_notices) for i in (101, 102, 103)] == [([], 0)] * 3
    assert licenses.scan(odd(spark)).count() == len(ODD) + 3


def test_wrapped_licenses(spark):
    whole = {"MIT": [5], "GPL-3.0": [4], "GPL-2.0": [4], "LGPL": [3], "AGPL": [3], "BSD": [3, 4]}
    more = " and some words that follow the notice in the text of the file"
    rows, want = [], []

    def add(text, families, unknown=0):
        rows.append((len(rows), text))
        want.append((families, unknown))

    for f, at in whole.items():
        for i in at:
            for width in (1, 40, 70, 76, 80):
                for mark in ("", "# ", " * "):
                    lines = textwrap.wrap(licenses.TEMPLATES[f][i] + more, width, break_long_words=False)
                    add("\n".join(["A title", mark.strip(), *(mark + x for x in lines), mark.strip(), "the end"]), [f])
                    add("\n".join(["words of a line before it", *(mark + x for x in lines), "the end"]), [f])
    two = [licenses.TEMPLATES["MIT"][5], licenses.TEMPLATES["BSD"][3]]
    add("\n".join(x for t in two for x in textwrap.wrap(t, 72)), ["BSD", "MIT"])
    add("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\nwords", ["Apache-2.0", "MIT"])
    add(licenses.ORDINARY[0] + "\n" + licenses.ORDINARY[1] + "\nReleased under the MIT License.\n" + licenses.ORDINARY[4], ["MIT"], 3)
    add("\n".join(textwrap.wrap(" ".join(licenses.ORDINARY[:6]), 50)), [], None)
    add("This is free and unencumbered software released into the public\n# domain.", ["Unlicense"])
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bad = [(rows[i][1], out[i].licenses, out[i].unknown_notices, *w) for i, w in enumerate(want) if out[i].licenses != w[0] or w[1] not in (None, out[i].unknown_notices)]
    assert not bad, (len(bad), bad[:3])


def kneser_ney(words, counts, table, discount=0.75):
    """Log-likelihood ratio per letter of each word by the definition, in plain Python:
    two classes at the top order, shared continuation counts below."""
    n = toxicity.ORDER
    code = lambda w: (0,) * n + tuple(int(table[ord(c)]) for c in w) + (1,)
    every = lambda w: [c[i - n + 1 : i + 1] for c in [code(w)] for i in range(n, len(c))]
    top = [Counter(), Counter()]
    for w, pair in counts.items():
        for g in every(w):
            for k in (0, 1):
                top[k][g] += pair[k]
    kinds = {n: {g for k in (0, 1) for g, c in top[k].items() if c}}
    for m in range(n - 1, 0, -1):
        kinds[m] = Counter(g[1:] for g in kinds[m + 1])  # of how many longer n-grams it is the end

    def shared(g):
        if not g:
            return 1 / toxicity.CODES
        c = kinds[len(g)]
        total = sum(v for x, v in c.items() if x[:-1] == g[:-1])
        if not total:
            return 0.0
        branch = sum(x[:-1] == g[:-1] for x in c)
        return (max(c[g] - discount, 0) + discount * branch * shared(g[1:])) / total

    def probability(k, g):
        own = {x: c for x, c in top[k].items() if x[:-1] == g[:-1] and c}
        if not own:
            return shared(g[1:])
        total = sum(own.values())
        return max(own.get(g, 0) - discount, 0) / total + discount * len(own) / total * shared(g[1:])

    return [sum(math.log(probability(1, g) / probability(0, g)) for g in every(w)) / len(every(w)) for w in words]


def test_kneser_ney_by_brute_force():
    counts = {"idiot": (0, 5), "idea": (7, 1), "ideas": (2, 0), "the": (9, 4), "then": (1, 1), "öde": (3, 0), "it": (0, 1)}
    table = toxicity.code_table("".join(counts))
    gram, of = toxicity.grams(list(counts), table)
    order = np.argsort(gram)
    keys, o, t = toxicity._runs(gram[order], *[np.array([c[k] for c in counts.values()], float)[of][order] for k in (0, 1)])
    model = toxicity.Model.fit(table, keys, o, t)
    assert np.allclose(model.ratios(list(counts)), kneser_ney(list(counts), counts, table), atol=1e-5)
    assert len(set(table[[ord(c) for c in "idoteashnö"]].tolist())) == 10 and table[ord("日")] == toxicity._OTHER


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.98
    assert np.mean([r.predicted for r in out if r.toxic == 1]) > 0.88
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd(spark), empty)
    got = toxicity.score(odd(spark), model).collect()
    assert len(got) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(odd(spark).limit(0), model).count() == 0


def test_toxicity_of_long_repeated_and_clashing_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcde", k=5))
    rows = [(i, " ".join([word() for _ in range(32 - 2 * (i % 2))] + ["moron"] * (2 * (i % 2)))) for i in range(400)]
    marks = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), marks)
    long = (rows[0][1] + " ") * 5000
    more = [(1000, rows[0][1]), (1000, rows[0][1]), (1001, rows[1][1]), (1002, None), (1003, ""), (1004, long), (1005, rows[1][1].upper())]
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in more], "doc_id long, text string, `a.b` string, SCORE double")
    out = toxicity.score(df, model)
    assert out.columns == ["doc_id", "text", "a.b", "score", "predicted"]
    got = [(r.doc_id, r.predicted) for r in out.orderBy("doc_id").collect()]
    assert got == [(1000, 0), (1000, 0), (1001, 1), (1002, 0), (1003, 0), (1004, 0), (1005, 1)]


def test_network_gradients_and_language(spark, docs):
    net = langid.Network.fresh(["a", "b", "c"], 3, 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = np.array([[0, 97, 98, 32, 0], [97, 120, 121, 122, 32], [0, 0, 113, 97, 97]], np.uint8).T
    label = np.array([0, 2, 1])
    _, grad = net.step(x, label)
    for k in net.w:
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        own = net.w[k][at]
        net.w[k][at] = own + 1e-4
        up = net.step(x, label)[0]
        net.w[k][at] = own - 1e-4
        down = net.step(x, label)[0]
        net.w[k][at] = own
        assert abs((up - down) / 2e-4 - grad[k][at]) < 1e-3 * max(1e-3, abs(grad[k][at])), k
    trained = langid.train(docs, steps=120)
    out = langid.identify(docs, trained).where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.96
    got = {r.doc_id: r for r in langid.identify(odd(spark), trained).where("doc_id is not null").collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[3].lang_pred != "und"
    assert langid.train(docs.limit(0)).langs == []
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    assert langid.identify(docs.limit(0), trained).count() == 0


def test_language_of_whole_texts_by_brute_force():
    """Windows cover each text once, and pooling them is what reading each position
    with its own surroundings gives."""
    net = langid.Network.fresh(["a", "b"], 4, 7)
    net.w["v" + "f"] *= 0.2  # short memories: what stands beyond the edge doesn't matter
    net.w["vb"] *= 0.2
    rng = random.Random(3)
    texts = ["a", "ünï çode", *("".join(rng.choices("abcdef é", k=n)) for n in (50, langid.CORE - 2, langid.CORE - 1, langid.CORE, 977, 3001))]
    read = [langid.normal(t) for t in texts]
    x, size, of = langid.windows(read)
    for i, b in enumerate(read):
        own = np.flatnonzero(of == i)
        assert b"".join(x[langid.EDGE : langid.EDGE + size[k], k].tobytes() for k in own) == b
    lang, score = net.pool(texts)
    for t, b, l, s in zip(texts, read, lang, score):
        whole = np.frombuffer(b"\0" * langid.EDGE + b + b"\0" * langid.EDGE, np.uint8)[:, None]
        p = net.label(whole.astype(np.intp))[2][langid.EDGE : langid.EDGE + len(b), 0].sum(0) / len(b)
        assert l == net.langs[p.argmax()] and abs(p.max() - s) < 2e-3, t[:20]
    assert net.pool(texts[::-1])[0] == lang[::-1]


def test_a_worker_keeps_one_thing_and_forgets():
    from coppice.llm import common

    first = common.held("one", lambda: common.Words(room=20_000))
    assert common.held("one", list) is first
    for k in range(40):
        words = {f"w{k}-{i}" for i in range(50)} | {"always"}
        new = first.missing(words)
        first.put(new, [len(w) for w in new])
        assert all(first.young[w] == len(w) for w in words)
    assert len(first.young) + len(first.old) < 300 and "w0-0" not in {*first.young, *first.old}
    assert common.held("two", list) == [] and common._held[0] == "two"


def test_bpe_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    for r in bpe.encode_documents(odd(spark).unionByName(docs.withColumn("score", F.lit(""))), path).collect():
        pass
    texts = {r.doc_id: r.text for r in docs.collect()} | {1000 + i: t for i, t in enumerate(ODD)}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    for r in bpe.encode_documents(df, path).collect():
        ids = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == own.decode(ids, skip_special_tokens=False) == (texts[r.doc_id] or "")
    for r in bpe.encode_documents(df, path, digest=True).limit(5).collect():
        ids = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_token_counts(spark, docs):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    own = SentencePieceProcessor(model_file=path)
    texts = [r.text for r in docs.collect()] + ODD + [" " * 6000 + "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in tokencount.count_tokens(df, path).collect():
        t = texts[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (len(own.encode(t)), len(t.encode()), len(own.encode(t)) > 4096)


def shingle_set(t):
    w = t.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            k = len(sets[a] & sets[b])
            if k * 1.8 >= 0.8 * (len(sets[a]) + len(sets[b])) - 1e-9 or (not sets[a] and not sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def families(seed=3):
    """A family of copies around one text, its edges near the threshold, another
    family that shares a passage, exact copies, and single texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(150)] = word()
        texts[len(texts)] = " ".join(w)
    for i in range(30):
        texts[len(texts)] = " ".join([*[word() for _ in range(40)], *passage, *[word() for _ in range(40)]])
    for i in range(10):
        texts[len(texts)] = texts[61]
    for t in ("", " ", "one two", "one two", "one", "x " * 50, "x " * 60):
        texts[len(texts)] = t
    return texts


def test_near_duplicates(spark):
    texts = families()
    rows = [(i, t, "clash") for i, t in texts.items()] + [(500, None, "n"), (501, None, "n"), (None, "x", "n"), (3, texts[3], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    want = brute_classes(texts) | {500: 500, 501: 501}
    for block in (512, 7, 1):
        got = neardup.near_duplicates(df, block=block).collect()
        assert len(got) == len(rows)
        assert all(r.class_id == want.get(r.doc_id) for r in got), block
    kept = neardup.deduplicate(df).collect()
    assert Counter(r.doc_id for r in kept) == Counter({*want.values(), None})


def test_near_duplicates_that_repeat_a_passage(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = {}
    for k in range(60):
        head, passage = [word() for _ in range(60)], [word() for _ in range(50)]
        texts[2 * k] = " ".join(head + passage)
        texts[2 * k + 1] = " ".join(head + passage * (20, 50)[k % 2])
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = brute_classes(texts)
    assert all(want[2 * k + 1] == 2 * k for k in range(60))
    assert {r.doc_id: r.class_id for r in got} == want


def test_default_bands_propose_pairs_at_the_threshold():
    own = inspect.signature(neardup.near_duplicates).parameters
    bands, width, least = (own[k].default for k in ("bands", "width", "least"))
    assert (1 - least**width) ** bands < 1e-5
    rng, pairs, missed = np.random.default_rng(5), 5000, 0
    for _ in range(10):
        n = pairs // 10
        both, one, two = (rng.integers(1, 2**63, (n, k), dtype=np.uint64) for k in (80, 10, 10))
        sets = np.stack([np.hstack([both, one]), np.hstack([both, two])], 1).reshape(2 * n, 90)
        r = neardup.registers(np.repeat(np.arange(2 * n), 90), sets.ravel(), np.ones(sets.size), 2 * n, bands * width).reshape(n, 2, bands, width)
        missed += int((~(r[:, 0] == r[:, 1]).all(2).any(1)).sum())
    assert missed == 0


def test_block_links(monkeypatch):
    rng = random.Random(4)
    base = rng.sample(range(2**40), 60)
    sets = [[], base[:1], base[:1], *(sorted({*rng.sample(base, rng.randrange(50, 60)), *rng.sample(range(100), rng.randrange(8))}) for _ in range(80))]
    reps = rng.sample(range(1000), len(sets))
    parent = {r: r for r in reps}

    def root(r):
        return r if parent[r] == r else root(parent[r])

    for i, a in enumerate(sets):
        for j in range(i):
            k = len({*a} & {*sets[j]})
            if k and 10 * k >= 8 * (len(a) + len(sets[j]) - k):
                x, y = sorted((root(reps[i]), root(reps[j])))
                parent[y] = x
    want = {(root(r), r) for r in reps if root(r) != r}
    table = pa.table({"rep": pa.array(reps, pa.int64()), "set": pa.array(sets, pa.list_(pa.int64()))})
    for rare, columns in ((24, 4096), (1, 7), (200, 5)):
        monkeypatch.setattr(neardup, "_RARE", rare)
        monkeypatch.setattr(neardup, "_COLUMNS", columns)
        got = neardup.block_links(table, 0.8)
        assert {*zip(got["a"].to_pylist(), got["b"].to_pylist())} == want
    assert neardup.block_links(table.slice(0, 1), 0.8).num_rows == 0


def test_probability_jaccard():
    u = {1: 3.0, 2: 1.0, 3: 2.0, 4: 1.0}
    v = {1: 1.0, 2: 1.0, 3: 2.0, 5: 4.0}
    want = sum(1 / sum(max(u.get(e, 0) / u[d], v.get(e, 0) / v[d]) for e in {*u, *v}) for d in u.keys() & v.keys())
    rows = np.array([0] * 4 + [1] * 4)
    hashes = np.array([hash(("s", k)) % 2**63 for k in [*u, *v]], np.uint64)
    counts = np.exp(np.array([*u.values(), *v.values()]) - 1)  # the weight is 1 + ln(count)
    with np.errstate(over="ignore"):
        r = neardup.registers(rows, hashes, counts, 2, 4096)
    assert abs((r[0] == r[1]).mean() - want) < 0.03


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_pipeline_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "mixing", "bpe"]
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        before = table
        table = stage(spark, table, SF).persist()
        if name != "bpe":
            assert table.columns == corpus_pipeline.COLUMNS
        if name == "near_duplicates":
            texts = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id for r in table.collect()} == set(brute_classes(texts).values())
        elif name != "mixing":
            assert {r.doc_id for r in table.collect()} <= {r.doc_id for r in before.collect()}
    assert table.count() > 0 and zlib.crc32(b"1") % 4 in range(4)
