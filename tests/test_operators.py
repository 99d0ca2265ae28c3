"""Retrieval, evaluation, statistics, components: known answers, brute force, edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragstone.operators import evaluation as ev
from ragstone.operators import knn as nn
from ragstone.operators import rerank as rr
from ragstone.operators import statistics as st
from ragstone.operators.bm25 import BM25
from ragstone.operators.fusion import collapse, rrf, weighted_fusion
from ragstone.plans import pipelines
from ragstone.session import connected_components
from ragstone.sources import generators


def vecs(spark, rows):
    return spark.createDataFrame(rows, "id bigint, embedding array<float>, label int")


def test_knn_equals_brute_force_and_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    x[50] = x[51]
    df = vecs(spark, [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0] * 5, 0)])
    q = df.where("id % 10 = 0 and id < 150").withColumnRenamed("id", "qid")
    got = {(r["qid"], r["rank"]): r["id"] for r in nn.knn(df, q, 5).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for a in range(0, 150, 10):
        want = sorted((round(1 - float(u[a] @ u[b]), 9), b) for b in range(150))[:5]
        assert [got[a, r + 1] for r in range(5)] == [b for _, b in want]
    cols = {(r["qid"], r["rank"]): r["id"] for r in nn.knn_columns(df, q, 5).collect()}
    assert cols == got
    assert nn.knn(df, q, 5, exclude_self=True).where("qid = id").count() == 0
    assert nn.knn(df, q, 3, where=F.col("label") == 1).join(df.where("label <> 1"), "id").count() == 0
    assert nn.knn(df.limit(0), q).count() == 0 and nn.knn(df, q.limit(0)).count() == 0
    assert nn.knn(df.where("id < 3"), q, 10).count() == 3 * q.count()


def test_stored_ivf(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nn.IVFIndex, "SPLIT_ROWS", 40)  # cells in splits
    items = generators.clustered_vectors(spark, 600, 16, 8, 0.15, 1)
    q = items.where("id % 20 = 0").withColumnRenamed("id", "qid")
    nn.IVFIndex.build(items, str(tmp_path / "ivf"), cells=8)
    index = nn.IVFIndex(spark, str(tmp_path / "ivf"))  # reloaded
    assert index.sizes.sum() == 600
    sweep = {r["nprobe"]: r for r in nn.recall_sweep(index, items, q, 5, (1, 3, 8)).collect()}
    assert sweep[None]["recall"] == 1 and sweep[8]["recall"] == 1 and abs(sweep[8]["fraction_scanned"] - 1) < 1e-9
    assert sweep[1]["recall"] <= sweep[3]["recall"] <= 1 and sweep[1]["fraction_scanned"] < sweep[3]["fraction_scanned"] and sweep[1]["recall"] > 0.8
    assert sweep[3]["total_ms"] > 0 and index.search(q.limit(0)).count() == 0
    every = {(r["qid"], r["rank"]): r["id"] for r in index.search(q, 5, 8).collect()}
    assert every == {(r["qid"], r["rank"]): r["id"] for r in nn.knn(items, q, 5).collect()}


def test_rerank_and_maxsim(spark):
    texts = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, None), (4, "red red pear")], "id bigint, text string")
    ranking = spark.createDataFrame([(0, i, r) for r, i in enumerate((3, 2, 1, 4), 1)], "qid bigint, id bigint, rank bigint")
    asked = spark.createDataFrame([(0, "red pear")], "qid bigint, query string")
    got = rr.rerank(ranking, texts, asked, depth=4, k=4).orderBy("rank").collect()
    assert [r["id"] for r in got] == [4, 2, 1, 3] and got[0]["score"] == 1 and got[3]["score"] is None
    assert [r["id"] for r in rr.rerank(ranking, texts, asked, depth=2, k=4).orderBy("rank").collect()] == [2, 3]
    q, t = np.array([[1.0, 0], [0, 1]]), np.array([[0.5, 0.5], [1, 0]])
    assert rr.maxsim(q, t) == 1.5 and rr.maxsim(q, np.zeros((0, 2))) is None
    words = ["red", "green", "apple", "pear"]
    encode = lambda x: np.eye(4)[[words.index(w) for w in x.split()]] if x else np.zeros((0, 4))
    late = rr.late_interaction(ranking, texts, asked, encode, 4, 4).orderBy("rank").collect()
    assert [r["id"] for r in late] == [4, 2, 1, 3] and late[0]["score"] == 2


def test_fusion_after_coalesced_windows(spark):
    """Lists of very different sizes, both ranked by windows: the union must not trust their partitioning."""
    small = spark.range(40).selectExpr("id % 8 as qid", "id", "cast(id as double) as distance")
    large = spark.range(40_000).selectExpr("id % 8 as qid", "id div 8 as id", "cast(id as double) as distance")
    got = rrf([nn.ranked(small), nn.ranked(large)])
    assert got.groupBy("qid").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.countDistinct("rank").alias("d")).where("n <> m or n <> d").count() == 0


def corpus(spark):
    return spark.createDataFrame([(1, "red apple"), (2, "green apple"), (3, "blue sky")], "id bigint, text string")


def ask(spark, *qs):
    return spark.createDataFrame(list(enumerate(qs)), "qid bigint, query string")


def test_bm25_known_answers(spark):
    got = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in BM25(corpus(spark)).top_k(ask(spark, "red", "red red", "apple", "nothing", None), 3).collect()}
    assert len(got) == 15
    assert got[0, 1] == (1, round(math.log(8 / 3), 9)) and got[0, 2] == (2, 0.0) and got[0, 3] == (3, 0.0)
    assert abs(got[1, 1][1] - 2 * math.log(8 / 3)) < 1e-8
    assert got[2, 1][0] == 1 and got[2, 2][0] == 2 and abs(got[2, 1][1] - math.log(1.6)) < 1e-8 and got[2, 3] == (3, 0.0)
    assert [got[3, r][0] for r in (1, 2, 3)] == [1, 2, 3] == [got[4, r][0] for r in (1, 2, 3)]
    every = {(r["qid"], r["rank"]): r["id"] for r in BM25(corpus(spark)).rank_all(ask(spark, "red", "apple")).collect()}
    assert every == {k: v[0] for k, v in {(q, r): got[{0: 0, 1: 2}[q], r] for q in (0, 1) for r in (1, 2, 3)}.items()}


def test_bm25_against_loop(spark):
    rng = random.Random(1)
    vocab = [f"t{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 30))) or None) for i in range(60)]
    qs = [" ".join(rng.choice(vocab) for _ in range(4)) for _ in range(10)]
    toks = {i: (t or "").split() for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {t: sum(t in w for w in toks.values()) for t in vocab}
    got = {(r["qid"], r["rank"]): r["id"] for r in BM25(spark.createDataFrame(docs, "id bigint, text string")).top_k(ask(spark, *qs), 8).collect()}
    for q, text in enumerate(qs):
        def score(i):
            return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * toks[i].count(t) * 2.5 / (toks[i].count(t) + 1.5 * (0.25 + 0.75 * len(toks[i]) / avg)) for t in text.split())
        want = sorted(((-round(score(i), 9), i) for i in toks))[:8]
        assert [got[q, r + 1] for r in range(8)] == [i for _, i in want]


def test_bm25_empty(spark):
    e = corpus(spark).limit(0)
    assert BM25(e).top_k(ask(spark, "red"), 3).count() == 0 and BM25(e).frequencies().count() == 0


def ranking(spark, ids, q=1):
    return spark.createDataFrame([(q, i, r + 1) for r, i in enumerate(ids)], "qid bigint, id string, rank bigint")


def test_rrf(spark):
    a, b = ranking(spark, ["a", "b", "c"]), ranking(spark, ["c", "a"])
    got = {r["id"]: (r["rank"], r["score"]) for r in rrf([a, b]).collect()}
    assert [round(got[i][1], 6) for i in "acb"] == [0.032522, 0.032266, 0.016129] and [got[i][0] for i in "acb"] == [1, 2, 3]
    swapped = {r["id"]: r["score"] for r in rrf([b, a]).collect()}
    assert swapped == {i: v[1] for i, v in got.items()}
    tie = [r["id"] for r in rrf([ranking(spark, ["z", "a"]), ranking(spark, ["a", "z"])]).orderBy("rank").collect()]
    assert tie == ["z", "a"]


def test_weighted_fusion(spark):
    s = lambda d: spark.createDataFrame([(1, k, v) for k, v in d.items()], "qid bigint, id string, score double")
    got = {r["id"]: r["score"] for r in weighted_fusion([(s({"a": 2.0, "b": 1.0}), 0.5), (s({"b": 5.0, "c": 5.0}), 0.5)]).collect()}
    assert got == {"a": 0.5, "b": 0.0, "c": 0.0}


def test_collapse(spark):
    r = spark.createDataFrame([(1, i, i, s) for i, s in enumerate("AABAC", 1)], "qid bigint, id bigint, rank bigint, src string")
    assert {x["id"]: x["rank"] for x in collapse(r, "src").collect()} == {"A": 1, "B": 2, "C": 3}
    assert {x["id"] for x in collapse(r, "src", depth=2).collect()} == {"A"}


def test_scorecards(spark):
    ranks = spark.createDataFrame([(i, r) for i, r in enumerate([1] * 13 + [2, 3])], "qid int, rank int")
    got = ev.scorecard(ranks, digits=None).first()
    assert (got["recall_at_1"], got["recall_at_3"], got["recall_at_5"]) == (13 / 15, 1, 1)
    assert math.isclose(got["mrr"], 0.9222222, rel_tol=1e-6) and math.isclose(got["ndcg_at_5"], 0.942062, rel_tol=1e-6)
    q = spark.createDataFrame([(1, "g", "x"), (2, "none", "x")], "qid bigint, gold string, grp string")
    rk = ev.gold_ranks(q, ranking(spark, ["a", "g", "c"]))
    card = {r["qid"]: r["rank"] for r in rk.collect()}
    assert card == {1: 2, 2: None}
    one = ev.scorecard(rk.where("qid = 1")).first()
    assert (one["recall_at_1"], one["recall_at_3"], one["mrr"], one["ndcg_at_5"]) == (0, 1, 0.5, 0.63093)
    none = ev.scorecard(rk.where("qid = 2")).first()
    assert none["recall_at_5"] == none["mrr"] == none["ndcg_at_5"] == 0
    assert ev.hit_scorecard(rk, by=["grp"]).first()["hit_at_3"] == 0.5


def test_article_and_document_hits(spark):
    ret = spark.createDataFrame([(1, 1, "nada", "a"), (1, 2, "Artículo 5 dice", "b"), (2, 1, "Artículo 2o. dice", "c")], "qid bigint, rank bigint, text string, source string")
    q = spark.createDataFrame([(1, "5"), (2, "2")], "qid bigint, article string")
    r = ev.article_hits(ret, q).first()
    assert (r["art_hit_at_1"], r["art_hit_at_3"], r["mrr"]) == (0, 0.5, 0.25)
    assert ev.article_hits(ret, q, ordinal_aware=True).first()["art_hit_at_1"] == 0.5
    d = spark.createDataFrame([(1, "b", True), (2, "z", True), (3, None, False)], "qid bigint, doc string, in_corpus boolean")
    assert tuple(ev.document_hits(ret, d).first()) == (2, 1, 0.5)
    noise = ev.reference_noise(ret, F.col("source") == "a").first()["ref_noise"]
    assert noise == round(1 / 3, 6)


def test_leaderboard(spark):
    rows = spark.createDataFrame([("a", 0.1), ("b", None), ("c", 0.9)], "model string, mrr double")
    assert [r["model"] for r in ev.leaderboard(rows).collect()] == ["c", "a", "b"]


def test_statistics(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "v int")
    assert {r["point"]: r["value"] for r in st.percentiles(df, "v", [0.5, 0.9]).collect()} == {0.5: 2.5, 0.9: 7.9}
    assert {r["cap"]: (r["pct_fit"], r["n_over"]) for r in st.fit_under_caps(df, "v", (2, 10)).collect()} == {2: (50.0, 2), 10: (100.0, 0)}
    h = {r["bin"]: r["n"] for r in st.histogram(df, "v", 3).collect()}
    assert h == {0: 3, 1: 0, 2: 1}
    assert sum(r["n"] for r in st.histogram(df, "v", 4, 0, 4, clip=True).collect()) == 4
    t = spark.createDataFrame([(5, 1.0), (3, 2.0), (4, 2.0), (9, None)], "id int, v double")
    assert tuple(st.arg_max(t, "v", "id").first()) == (3, 2.0) and st.arg_max(t.limit(0), "v", "id").count() == 0
    c = spark.createDataFrame([("a  b c",), ("",), (None,)], "text string")
    assert tuple(st.chunk_stats(c).first()) == (3, 4.0)
    a = spark.createDataFrame([(1, "pre\nArtículo 1 a b\nArtículo 2 c")], "id int, text string")
    assert [(r["article_no"], r["n_words"]) for r in st.article_word_counts(a, "id").orderBy("article_no").collect()] == [(0, 4), (1, 3)]


def test_pipeline_evaluates_three_retrievers(spark):
    docs = spark.createDataFrame([(1, "a", "The pump ERR_4521 means low pressure in the line"), (2, "b", "A bolt M8x40 needs torque"), (3, "c", "Batteries last long on one charge"), (4, "d", None)], "id bigint, source string, text string")
    chunks = pipelines.ingest(docs, lambda c: F.array(c))
    q = spark.createDataFrame([(1, "what is ERR_4521", "a", "exact"), (2, "torque of bolt M8x40", "b", "exact"), (3, "how long is one charge", "c", "semantic")], "qid bigint, query string, gold string, grp string")
    got = {(r["retriever"], r["grp"]): r for r in pipelines.evaluate(chunks, q, depth=3).collect()}
    assert len(got) == 6 and got["bm25", "exact"]["hit_at_1"] == 1 and got["hybrid", "exact"]["hit_at_1"] == 1
    row = pipelines.bake_off(chunks.where("source <> 'd'"), q, "hash-64", 64).first()
    assert row["n_chunks"] == 3 and row["recall_at_5"] == 1
    ab = pipelines.ablation({("hash-64", True): chunks.where("text is not null")}, q).first()
    assert ab["n_chunks"] == 3 and ab["ref_noise"] == 0


def test_pipeline_ranks_all_chunks(spark):
    """The gold paper shares no term and is the last of 40 chunks: its rank counts, it is not cut off."""
    docs = spark.createDataFrame([(i, f"s{i}", "pump " * (i % 5 + 1) + f"valve{i}") for i in range(1, 40)] + [(40, "gold", "omega")], "id bigint, source string, text string")
    chunks = pipelines.ingest(docs, lambda c: F.array(c), clean=False)
    q = spark.createDataFrame([(1, "pump", "gold", "exact")], "qid bigint, query string, gold string, grp string")
    got = {r["retriever"]: r["mrr"] for r in pipelines.evaluate(chunks, q, by_group=False).collect()}
    assert math.isclose(got["bm25"], 1 / 40, abs_tol=1e-6) and len(got) == 3 and min(got.values()) > 0
    assert {n: r.count() for n, r in pipelines.retrieve(chunks, q, k=None).items()} == {"bm25": 40, "dense": 40, "hybrid": 40}
    cut = {r["retriever"]: r["mrr"] for r in pipelines.evaluate(chunks, q, depth=30, by_group=False).collect()}
    assert cut["bm25"] == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
