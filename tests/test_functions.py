"""Column functions: known answers and properties."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hst
from pyspark.sql import functions as F

from ragstone.functions import chunkers, embedders, text, vector


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


def test_vectors(spark):
    rows = [(1, "apple", [1.0, 0.0, 0.0]), (2, "banana", [0.9, 0.1, 0.0]), (3, "rocket", [0.0, 0.0, 1.0]), (4, "zero", [0.0, 0.0, 0.0]), (5, "null", None), (6, "short", [1.0])]
    df = spark.createDataFrame(rows, "id int, name string, e array<float>")
    q = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    got = {r["name"]: r for r in df.select("name", vector.cosine_distance(F.col("e"), q).alias("d"), vector.l2_distance(F.col("e"), q).alias("l2"), vector.negative_inner_product(F.col("e"), q).alias("nip"), vector.l2_normalise(F.col("e")).alias("u")).collect()}
    assert got["apple"]["d"] == 0 and abs(got["banana"]["d"] - 0.0061) < 1e-4 and got["rocket"]["d"] == 1
    assert got["zero"]["d"] is None and got["null"]["d"] is None and got["short"]["d"] is None and got["zero"]["u"] is None
    assert math.isclose(got["rocket"]["l2"], math.sqrt(2)) and got["apple"]["nip"] == -1
    assert df.where(vector.has_dim(F.col("e"), 3)).count() == 4


@pytest.mark.parametrize("n,size,lap,expect", [(100, 40, 10, 3), (60, 60, 15, 1), (61, 60, 15, 2), (0, 60, 15, 0), (12, 10, 10, 3)])
def test_fixed_counts(spark, n, size, lap, expect):
    got = one(spark, " ".join(f"w{i}" for i in range(n)), lambda c: chunkers.fixed(c, size, lap))
    assert len(got) == expect and all(len(x.split()) <= size for x in got)


def windows(items, size, lap):
    step, out, i = max(1, size - lap), [], 0
    while items:
        out.append(" ".join(items[i : i + size]))
        if i + size >= len(items):
            break
        i += step
    return out


def test_fixed_against_loop(spark):
    rng = random.Random(0)
    texts = [" ".join("x" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    for size, lap in ((10, 3), (7, 7), (1, 0), (50, 20)):
        got = [r["r"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").orderBy("i").select(chunkers.fixed(F.col("c"), size, lap).alias("r")).collect()]
        assert got == [windows(t.split(), size, lap) for t in texts]


def test_sentences_and_groups(spark):
    assert one(spark, "A b. C d!  E?\nF", chunkers.sentences) == ["A b.", "C d!", "E?", "F"]
    assert len(one(spark, "A. B. C. D.", lambda c: chunkers.sentence_groups(c, 2, 1))) == 3
    assert one(spark, "Dr. Smith paid 3.5 dollars. He left.", chunkers.protected_sentences) == ["Dr. Smith paid 3.5 dollars.", "He left."]
    assert one(spark, None, chunkers.sentences) is None and one(spark, "  ", chunkers.fixed) == []


def test_recursive(spark):
    got = one(spark, "One two. Three four five. Six seven eight nine ten eleven. Twelve.", lambda c: chunkers.recursive(c, 5))
    assert got == ["One two. Three four five.", "Six seven eight nine ten", "eleven.", "Twelve."]
    assert one(spark, "", lambda c: chunkers.recursive(c, 5)) == []


def test_articles(spark):
    t = "Pre\n\n## **Artículo 1o.** uno\ndos\n\nARTÍCULO 2 tres\n"
    assert one(spark, t, chunkers.by_article) == ["Pre", "## **Artículo 1o.** uno\ndos", "ARTÍCULO 2 tres"]
    assert len(one(spark, "cita Artículo 9 inline\n_Artículo 10_ z", chunkers.by_article)) == 2
    assert one(spark, "sin marcas", chunkers.by_article) == ["sin marcas"]
    spans = one(spark, t, chunkers.article_spans)
    assert len(spans) == 2 and "".join(["Pre\n", *spans]) == t and one(spark, "sin marcas", chunkers.article_spans) == []
    long = "Artículo 1 " + "w " * 300
    assert [len(x.split()) for x in one(spark, long, chunkers.by_article)] == [250, 77]


def test_article_names(spark):
    has = lambda t, n, **k: one(spark, t, lambda c: text.has_article(c, F.lit(n), **k))
    assert has("Artículo 2o.", 2) is False and has("Artículo 2o.", 2, ordinal_aware=True) is True
    assert has("ARTÍCULO 13.", 13) is True and has("Artículo 13", 1) is False
    assert one(spark, "CPF Art. 14 y Art 15", text.article_number) == "14" and one(spark, "none", text.article_number) == ""
    assert one(spark, "Artículo 3 y artículo 3, ARTÍCULO 44.", text.article_numbers) == ["3", "44"]


def test_semantic(spark):
    vs = [(1.0, 0.0), (0.9, 0.436), (0.0, 1.0), (0.0, 1.0)]
    df = spark.createDataFrame([(1, i, f"s{i}", list(v)) for i, v in enumerate(vs)] + [(2, 0, "alone", [1.0, 0.0])], "d int, i int, t string, e array<float>")
    got = {(r["d"], r["chunk_index"]): r["chunk"] for r in chunkers.semantic(df, "d", "i", "t", "e", 0.5).collect()}
    assert got == {(1, 0): "s0 s1", (1, 1): "s2 s3", (2, 0): "alone"}
    edge = spark.createDataFrame([(1, 0, "a", [1.0, 0.0]), (1, 1, "b", [0.5, 0.0])], "d int, i int, t string, e array<double>")
    assert chunkers.semantic(edge, "d", "i", "t", "e", 0.5).count() == 1


def test_strategies_and_plugin(spark):
    df = spark.createDataFrame([(1, "a b c. d e f.", 9), (2, None, 9)], "id int, text string, chunk_index_of int")
    made = chunkers.strategy_chunks(df)
    assert made.select("strategy").distinct().count() == 4 and made.where("id = 2").count() == 0
    assert [r["chunk"] for r in chunkers.apply_chunker(df, lambda t: t.split(". ")).orderBy("chunk_index").collect()] == ["a b c", "d e f."]
    assert chunkers.explode_chunks(df, lambda c: chunkers.fixed(c, 2, 0)).count() == 3


def test_words_and_tokens(spark):
    assert one(spark, "x\x1cy\u00a0z", text.word_count) == 3
    assert one(spark, "ERR_4521, M8x40! café", text.tokens) == ["err_4521", "m8x40", "caf"]
    assert one(spark, "a  b c", text.single_blank_pieces) == 4 and one(spark, "", text.single_blank_pieces) is None
    assert one(spark, " \u00a0a b\x1f ", text.strip) == "a b"
    assert one(spark, "a \n\t b", text.collapse) == "a b"
    assert one(spark, "x" * 240, text.snippet) == "x" * 237 + "..." and one(spark, "x" * 239, text.snippet) == "x" * 239


def test_reference_density(spark):
    refs = "Rivera M.K. Okafor T. Soil moisture sensing. Field Sci 12, 301-318. Lindqvist P."
    prose = "The plot was irrigated in the morning and the yield of the crop was measured by the team."
    assert abs(one(spark, refs, text.reference_density) - 64.153846) < 1e-5 and one(spark, prose, text.reference_density) == 0
    assert one(spark, refs, text.is_reference_chunk) is True and one(spark, prose, text.is_reference_chunk) is False
    assert one(spark, "Okafor T. 12-19", text.reference_density) == 118 and one(spark, "Okafor T. 12-19", text.is_reference_chunk) is False
    assert one(spark, "", text.reference_density) == 18


def test_bibliography(spark):
    assert one(spark, "a b\n\n## References\n[1] x", text.cut_bibliography) == "a b\n"
    assert one(spark, "see references inside", text.cut_bibliography) == "see references inside"
    assert one(spark, "x\nReferences to this are prose", text.cut_bibliography) == "x\n"


def test_names(spark):
    name = lambda *a: spark.range(1).select(text.table_name(*[F.lit(x) for x in a]).alias("r")).first()["r"]
    assert name("penal", "bge-small", "article") == "penal__bge_small__article" and name("ram", "qwen06") == "ram__qwen06__fixed"
    assert one(spark, "s3a://b/x/a.b.md", text.file_stem) == "a.b" and one(spark, "/x/.hidden", text.file_name) == ".hidden"


def test_markup_and_instruction(spark):
    assert one(spark, "<p>a &amp; b</p>", lambda c: text.unescape_html(text.strip_tags(c))) == "a & b"
    assert one(spark, "q", lambda c: text.instructed(c, F.lit("Qwen3-X"), "I: ")) == "I: q" and one(spark, "q", lambda c: text.instructed(c, F.lit("minilm"))) == "q"
    r = spark.createDataFrame([("# A\n## B\n| a | b |\nword\n#no",)], "c string").select(*[c.alias(n) for n, c in text.markdown_stats(F.col("c")).items()]).first()
    assert (r["n_words"], r["n_headings"], r["n_table_rows"]) == (11, 2, 1)


def test_hash_embedding_equals_python(spark):
    texts = ["red apple red", "", "ERR_4521 and more", "ñandú"]
    got = [r["r"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").orderBy("i").select(embedders.hash_embedding(F.col("c")).alias("r")).collect()]
    want = embedders.HashingEmbedder(64).encode(texts)
    assert got[1] is None
    for i in (0, 2, 3):
        assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got[i], want[i]))


def test_embed_and_registry(spark):
    df = spark.createDataFrame([(1, "red apple"), (2, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in embedders.embed(df, lambda: embedders.get_embedder("hash-32"), key="t").collect()}
    assert len(got[1]) == 32 and got[2] is None
    with pytest.raises(RuntimeError):
        embedders.get_embedder("minilm")


@settings(max_examples=20, deadline=None)
@given(hst.integers(0, 80), hst.integers(1, 20), hst.integers(0, 25))
def test_window_formula(n, size, lap):
    step = max(1, size - lap)
    count = 0 if n == 0 else max(-(-(n - size) // step), 0) + 1
    assert count == len(windows([str(i) for i in range(n)], size, lap))
