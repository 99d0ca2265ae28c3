"""The registry of core queries, each over its whole tables, and (in ``sql``) their SQL."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragstone.functions import chunkers, text, vector
from ragstone.functions.embedders import HashingEmbedder, embed, hash_embedding
from ragstone.operators import evaluation as ev
from ragstone.operators import knn as nn
from ragstone.operators import statistics as st
from ragstone.operators.bm25 import BM25
from ragstone.operators.fusion import collapse, rrf, weighted_fusion
from ragstone.operators.rerank import late_interaction as late
from ragstone.operators.rerank import rerank
from ragstone.plans import pipelines
from ragstone.session import hadoop_path, materialize, read_table, shared_dir, spread
from ragstone.sources import files, generators, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "text", "source", "lang"))


def paper(source) -> F.Column:
    """The paper that a stored source name means: case, outer blanks and a file suffix do not matter."""
    return F.regexp_replace(F.lower(text.strip(source)), "\\.(pdf|md|txt)$", "")


def papers(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "ram_rag").select("id", paper(F.col("source")).alias("source"), "text")
    return spread(rows)


_STORED: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table written once per session and data folder, and read by every query that asks for it again."""
    at = (spark.sparkContext.applicationId, d, name)
    got = _STORED.get(at)
    if got is not None:
        fs, p = hadoop_path(spark, got.inputFiles()[0]) if got.inputFiles() else (None, None)
        if fs is None or not fs.exists(p):
            got = None  # the scratch folder was cleared
    if got is None:
        got = _STORED[at] = materialize(build(), name)
    return got


def store(spark: SparkSession, d: str) -> DataFrame:
    """The chunk store: papers with their embeddings, written once and read by the searches."""
    return stored(spark, d, "store", lambda: papers(spark, d).withColumn("embedding", hash_embedding(F.col("text"))))


def folder(spark: SparkSession, d: str, name: str) -> str:
    """A folder of this session for files that a query writes and reads back."""
    return f"{shared_dir(spark)}/scratch/{spark.sparkContext.applicationId}/{name}-{abs(hash(d)) % 10**9}"


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The held-out questions; group: their language by the opening question mark."""
    return read_table(spark, d, "eval_pairs").select(
        F.col("item_id").alias("qid"), F.col("question").alias("query"), F.col("gold_source").alias("gold"),
        F.when(F.col("question").startswith("¿"), "es").otherwise("en").alias("grp"))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ------------------------------------------------------------------ vectors


def _vectors(spark, d):
    items = read_table(spark, d, "embeddings")
    return items, items.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid")


@query
def knn_exact(spark, d):
    items, asks = _vectors(spark, d)
    return nn.knn(items, asks, 10, item_id="vec_id")


@query
def knn_filtered(spark, d):
    items, asks = _vectors(spark, d)
    return nn.knn(items, asks, 10, item_id="vec_id", where=F.col("label") == 3)


@query
def knn_self_excluded(spark, d):
    items, asks = _vectors(spark, d)
    return nn.knn(items, asks, 10, item_id="vec_id", exclude_self=True)


@query
def knn_columns(spark, d):
    items, asks = _vectors(spark, d)
    return nn.knn_columns(items, asks, 10, item_id="vec_id")


@query
def knn_single(spark, d):
    """One question against the table: order by distance, limit k."""
    items, _ = _vectors(spark, d)
    one = items.where("vec_id = 0").select(F.col("embedding").alias("q"))
    scored = items.join(one, F.lit(True)).select(F.col("vec_id").alias("id"), vector.cosine_distance(F.col("q"), F.col("embedding")).alias("distance"))
    scored = scored.where("distance is not null").withColumn("distance", F.round(F.greatest(F.lit(0.0), "distance"), 9))
    return scored.orderBy("distance", "id").limit(3)


@query
def vector_norms(spark, d):
    items, _ = _vectors(spark, d)
    e = F.col("embedding")
    first = F.array(*[F.lit(1.0)] + [F.lit(0.0)] * 63).cast("array<float>")
    return items.select(
        F.col("vec_id").alias("id"), F.round(vector.norm(e), 6).alias("norm"), F.round(vector.norm(vector.l2_normalise(e)), 5).alias("unit_norm"),
        F.round(vector.l2_distance(e, first), 6).alias("l2"), F.round(vector.negative_inner_product(e, first), 6).alias("nip"),
        F.round(vector.cosine_distance(e, first), 6).alias("cosine"), vector.has_dim(e, 64).alias("is_64"))


def _index(spark, d):
    path = folder(spark, d, "ivf")
    fs, p = hadoop_path(spark, f"{path}/cells/_SUCCESS")
    return nn.IVFIndex(spark, path) if fs.exists(p) else nn.IVFIndex.build(read_table(spark, d, "embeddings"), path, "vec_id")


def _enough(index) -> int:
    """Probes for a recall of 0.9 on vectors without clusters, where cells say little: three quarters of the cells."""
    return max(1, round(0.75 * len(index.centres)))


@query
def ivf_knn(spark, d):
    """The stored index is built by the first search of a session and opened by the next ones."""
    index = _index(spark, d)
    return index.search(_vectors(spark, d)[1], 10, _enough(index))


@query
def ivf_recall(spark, d):
    """Whether the index reaches a recall of 0.9 on the test vectors, and on clustered ones under 0.3 of the rows scanned; all of them indexed."""
    items, asks = _vectors(spark, d)
    index = _index(spark, d)
    plain = nn.recall_at_k(nn.knn(items, asks, 10, item_id="vec_id"), index.search(asks, 10, _enough(index)), 10)
    made = stored(spark, d, "clustered", lambda: generators.clustered_vectors(spark, 20_000, 32, 100, 0.1, 5))
    path = folder(spark, d, "ivf-clustered")
    fs, p = hadoop_path(spark, f"{path}/cells/_SUCCESS")
    other = nn.IVFIndex(spark, path) if fs.exists(p) else nn.IVFIndex.build(made, path)
    q = made.where("id % 100 = 0").withColumnRenamed("id", "qid")
    near = nn.recall_at_k(nn.knn(made, q, 10), other.search(q, 10, 16), 10).withColumnRenamed("recall", "near")
    total = index._rows(spark, index.path).agg(F.count("*").alias("indexed"))
    parts = plain.join(near, F.lit(True)).join(other.scanned(q, 16), F.lit(True)).join(total, F.lit(True))
    return parts.select((F.col("recall") >= 0.9).alias("recall_ok"), (F.col("near") >= 0.9).alias("clustered_ok"), (F.col("fraction_scanned") < 0.3).alias("scanned_ok"), "indexed")


@query
def ann_recall_sweep(spark, d):
    items, asks = _vectors(spark, d)
    index = _index(spark, d)
    cells = len(index.centres)
    return nn.recall_sweep(index, items, asks, 10, sorted({1, cells // 4, cells // 2, 3 * cells // 4, cells} - {0}), item_id="vec_id")


@query
def recall_of_exact(spark, d):
    """Recall of the filtered search against the unfiltered one: the same measure as for an index, on two exact lists."""
    items, asks = _vectors(spark, d)
    full, part = nn.knn(items, asks, 10, item_id="vec_id"), nn.knn(items, asks, 10, item_id="vec_id", where=F.col("label") < 5)
    return rounded(nn.recall_at_k(full, part, 10), "recall")


# ------------------------------------------------------------------ chunking and text


def _chunks(spark, d, f, **kw):
    return chunkers.explode_chunks(documents(spark, d).select("doc_id", "text"), lambda c: f(c, **kw))


@query
def chunk_fixed(spark, d):
    return _chunks(spark, d, chunkers.fixed, size=150, overlap=25)


@query
def chunk_fixed_small(spark, d):
    return _chunks(spark, d, chunkers.fixed, size=40, overlap=10)


@query
def chunk_sentence(spark, d):
    return _chunks(spark, d, chunkers.sentences)


@query
def chunk_sentence_groups(spark, d):
    return _chunks(spark, d, chunkers.sentence_groups, per_chunk=3, overlap=1)


@query
def chunk_protected_sentences(spark, d):
    return _chunks(spark, d, chunkers.protected_sentence_groups)


@query
def chunk_recursive(spark, d):
    return _chunks(spark, d, chunkers.recursive, size=40)


@query
def chunk_by_article(spark, d):
    return _chunks(spark, d, chunkers.by_article)


@query
def chunk_strategies(spark, d):
    made = chunkers.strategy_chunks(documents(spark, d).select("doc_id", "text"))
    return st.chunk_stats(made, "chunk", by=["strategy"])


@query
def chunk_semantic(spark, d):
    """Sentences of the documents, embedded by hashing, cut where neighbours differ."""
    s = _chunks(spark, d, chunkers.sentences).withColumn("embedding", F.coalesce(hash_embedding(F.col("chunk")), F.array(*[F.lit(0.0)] * 64).cast("array<float>")))
    got = chunkers.semantic(s, "doc_id", "chunk_index", "chunk", "embedding", 0.5)
    return got.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("n_sentences").cast("long").alias("n_sentences"), F.md5("chunk").alias("chunk_md5"))


@query
def article_words(spark, d):
    return st.article_word_counts(documents(spark, d), "doc_id").withColumn("article_no", F.col("article_no").cast("long"))


@query
def article_mentions(spark, d):
    """Documents that name each article."""
    found = documents(spark, d).select(F.explode(text.article_numbers(F.col("text"))).alias("article"))
    return found.groupBy("article").agg(F.count("*").alias("n"))


@query
def chunk_stats(spark, d):
    return st.chunk_stats(read_table(spark, d, "chunk_lab"), by=["strategy"])


@query
def chunk_stats_of_strategy(spark, d):
    return st.chunk_stats(read_table(spark, d, "chunk_lab").where("strategy = 'by-article'"))


def _lengths(spark, d):
    return documents(spark, d).select("doc_id", text.word_count(F.col("text")).alias("n"))


@query
def word_percentiles(spark, d):
    return st.percentiles(_lengths(spark, d), "n", [0.5, 0.9, 0.95] + [i / 10 for i in range(11) if i not in (5, 9)])


@query
def words_under_caps(spark, d):
    return st.fit_under_caps(_lengths(spark, d), "n")


@query
def word_histogram(spark, d):
    return st.histogram(_lengths(spark, d), "n", 40, 0, 800, clip=True)


@query
def tokenize(spark, d):
    t = text.tokens(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query
def markdown_quality(spark, d):
    return documents(spark, d).select("doc_id", *[c.alias(n) for n, c in text.markdown_stats(F.col("text")).items()])


def _density(spark, d):
    rows = spread(read_table(spark, d, "ram_rag").select("id", "text").where("text is not null"))
    return rows.select("id", text.word_count(F.col("text")).alias("w"), text.reference_density(F.col("text")).alias("density"))


@query
def ref_density(spark, d):
    return _density(spark, d).select("id", F.round("density", 6).alias("density"), ((F.col("w") >= 8) & (F.round("density", 9) >= 20)).alias("is_ref"))


@query
def ref_density_band(spark, d):
    return _density(spark, d).where("density > 20 and density < 30").select("id", F.round("density", 6).alias("density"))


@query
def ref_density_top(spark, d):
    return st.arg_max(_density(spark, d).withColumn("density", F.round("density", 6)), "density", "id")


@query
def ref_clean(spark, d):
    rows = spread(read_table(spark, d, "ram_rag").select("id", "text"))
    return rows.where(F.col("text").isNotNull() & ~text.is_reference_chunk(F.col("text"))).select("id")


@query
def bibliography_cut(spark, d):
    rows = spread(read_table(spark, d, "ram_rag").select("id", "text"))
    return rows.select("id", F.length(text.cut_bibliography(F.col("text"))).cast("long").alias("kept"))


@query
def snippets(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", F.md5(text.snippet(t)).alias("snippet"), F.md5(text.collapse(t, 150)).alias("flat"))


@query
def table_names(spark, d):
    rows = read_table(spark, d, "naive_rag").select("source", "model").distinct()
    return rows.select("source", "model", text.table_name(F.col("source"), F.col("model")).alias("name"), text.file_stem(F.col("source")).alias("stem"))


@query
def instructed_queries(spark, d):
    return questions(spark, d).select("qid", F.md5(text.instructed(F.col("query"), F.lit("Qwen3-Embedding"))).alias("with"), F.md5(text.instructed(F.col("query"), F.lit("minilm"))).alias("without"))


@query
def plain_of_markup(spark, d):
    return documents(spark, d).select("doc_id", F.md5(text.strip_tags(F.concat(F.lit("<p class='x'>"), F.col("text"), F.lit("</p>")))).alias("plain"))


# ------------------------------------------------------------------ retrieval


@query
def bm25_terms(spark, d):
    return BM25(papers(spark, d)).postings()


@query
def bm25_idf(spark, d):
    return rounded(BM25(papers(spark, d)).idf(), "idf")


@query
def bm25_corpus(spark, d):
    return rounded(BM25(papers(spark, d)).corpus(), "avgdl")


@query
def bm25_topk(spark, d):
    return rounded(BM25(papers(spark, d)).top_k(questions(spark, d), 10), "score")


@query
def hash_embed(spark, d):
    return store(spark, d).select("id", F.posexplode("embedding").alias("pos", "value")).select("id", F.col("pos").cast("long").alias("pos"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query
def dense_topk(spark, d):
    return pipelines.dense(store(spark, d), questions(spark, d), 10)


def _both(spark, d):
    """Chunks, questions, and the rankings of all chunks for all questions, dense and lexical."""
    chunks, asked = store(spark, d), questions(spark, d)
    near = stored(spark, d, "near", lambda: pipelines.dense(chunks, asked, max(1, chunks.count())))
    return chunks, asked, near, stored(spark, d, "lexical", lambda: BM25(chunks).rank_all(asked))


@query
def rrf_fusion(spark, d):
    _, _, near, lexical = _both(spark, d)
    return rounded(rrf([near, lexical], 60, 10), "score", digits=9)


@query
def weighted_sum_fusion(spark, d):
    _, _, near, lexical = _both(spark, d)
    return rounded(weighted_fusion([(near.select("qid", "id", (1 - F.col("distance")).alias("score")), 0.5), (lexical, 0.5)], 10), "score")


@query
def doc_rank_collapse(spark, d):
    chunks, _, _, lexical = _both(spark, d)
    return collapse(lexical.join(chunks.select("id", "source"), "id").where("source is not null"), "source").withColumn("first_rank", F.col("first_rank").cast("long"))


def _paper_ranks(spark, d):
    chunks, asked, near, lexical = _both(spark, d)
    owners = materialize(chunks.where("source is not null").select("id", "source"), "rank")
    kinds = {"bm25": lexical, "dense": near, "hybrid": rrf([near, lexical], 60)}
    both = None
    for name, r in kinds.items():
        p = collapse(r.select("qid", "id", "rank").join(owners, "id"), "source").select(F.lit(name).alias("retriever"), "qid", "id", "rank")
        both = p if both is None else both.unionByName(p)
    return ev.gold_ranks(asked.where("gold is not null"), both, by=["retriever"])


@query
def gold_ranks(spark, d):
    return _paper_ranks(spark, d).drop("grp")


@query
def scorecard(spark, d):
    return ev.scorecard(_paper_ranks(spark, d), by=["retriever"])


@query
def scorecard_by_group(spark, d):
    return ev.hit_scorecard(_paper_ranks(spark, d), by=["retriever", "grp"])


@query
def leaderboard(spark, d):
    rows = ev.scorecard(_paper_ranks(spark, d), by=["retriever"]).withColumnRenamed("retriever", "model")
    return ev.leaderboard(rows).select("model", "mrr")


@query
def upsert_scorecard(spark, d):
    """Two stored rows, one of them replaced."""
    old = spark.createDataFrame([("bm25", 0.1), ("old", 0.2)], "model string, mrr double")
    new = ev.scorecard(_paper_ranks(spark, d), by=["retriever"]).select(F.col("retriever").alias("model"), "mrr")
    return sinks.upsert(old, new, "model")


@query
def document_hits(spark, d):
    """Share of questions whose paper is among the sources of the first three chunks."""
    chunks, asked, _, lexical = _both(spark, d)
    got = lexical.join(chunks.select("id", "source"), "id")
    q = asked.select("qid", F.col("gold").alias("doc"), F.col("gold").isNotNull().alias("in_corpus"))
    return ev.document_hits(got, q, 3)


@query
def gold_counts(spark, d):
    return questions(spark, d).agg(
        F.countDistinct("gold").alias("golds"), F.sum(F.col("gold").isNotNull().cast("long")).alias("in_corpus"), F.sum(F.col("gold").isNull().cast("long")).alias("control"))


@query
def ablation(spark, d):
    raw = store(spark, d).where("text is not null and embedding is not null").select("id", "text", "embedding")
    raw = materialize(raw.withColumn("is_ref", text.is_reference_chunk(F.col("text"))), "rank")
    return pipelines.ablation({("hash-64", False): raw.drop("is_ref"), ("hash-64", True): raw.where("not is_ref").drop("is_ref")}, questions(spark, d))


@query
def bake_off(spark, d):
    return pipelines.bake_off(store(spark, d).where("source is not null"), questions(spark, d).where("gold is not null"), "hash-64", 64)


@query
def abstention(spark, d):
    """Retrieval gating: questions whose nearest chunk is farther than a threshold are not answered."""
    top = pipelines.dense(store(spark, d), questions(spark, d), 1)
    return top.select("qid", (F.round("distance", 6) > 0.5).alias("abstain"))


# ------------------------------------------------------------------ tables


@query
def bm25_all(spark, d):
    """The dense score table: every chunk for every question, zero scores included."""
    return rounded(_both(spark, d)[3], "score").groupBy("qid").agg(
        F.count("*").alias("n"), F.sum((F.col("score") == 0).cast("long")).alias("zeros"), F.min(F.when(F.col("rank") == F.lit(37), F.col("id"))).alias("id_37"))


@query
def evaluate_all(spark, d):
    """The whole hybrid evaluation: three retrievers over all chunks, by question group."""
    chunks = store(spark, d).where("source is not null")
    return pipelines.evaluate(chunks, questions(spark, d).where("gold is not null"))


@query
def rrf_k_sweep(spark, d):
    """Sensitivity to the constant of reciprocal rank fusion."""
    chunks, asked, near, lexical = _both(spark, d)
    owners, both = chunks.where("source is not null").select("id", "source"), None
    for k in (10, 60, 100):
        p = collapse(rrf([near, lexical], k).join(owners, "id"), "source").select(F.lit(k).alias("rrf_k"), "qid", "id", "rank")
        both = p if both is None else both.unionByName(p)
    return ev.scorecard(ev.gold_ranks(asked.where("gold is not null"), both, by=["rrf_k"]), by=["rrf_k"])


@query
def reranked(spark, d):
    """The first 50 chunks by BM25, ranked anew by the share of question words they hold, the best five."""
    chunks, asked, _, lexical = _both(spark, d)
    return rounded(rerank(lexical, chunks, asked), "score")


def _word_vectors(value: str) -> np.ndarray:
    """A unit vector per word, by hash bucket."""
    found = [int(hashlib.md5(w.encode()).hexdigest()[:6], 16) % 32 for w in re.findall("[a-z0-9_]+", value.lower())]
    return np.eye(32)[found] if found else np.zeros((0, 32))


@query
def late_interaction(spark, d):
    """MaxSim over the first ten chunks by BM25; with these vectors the score counts the question's words with a bucket in the chunk."""
    chunks, asked, _, lexical = _both(spark, d)
    return late(lexical, chunks, asked, _word_vectors, 10, 5).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query
def parent_child(spark, d):
    rows = chunkers.parent_child(documents(spark, d).select("doc_id", "text"), lambda c: chunkers.fixed(c, 150, 0), lambda c: chunkers.fixed(c, 40, 10))
    return rows.select("doc_id", F.col("parent_index").cast("long").alias("parent_index"), F.col("child_index").cast("long").alias("child_index"), F.md5("child").alias("child"))


@query
def embed_batches(spark, d):
    """The Python embedder interface, in Arrow batches, against the same hashing in columns."""
    rows = embed(papers(spark, d).select("id", "text"), lambda: HashingEmbedder(64), key="hash-64")
    return rows.select("id", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total")).where("total > 0")


# ------------------------------------------------------------------ files


def _put(spark, rows: DataFrame, path: str, name: str, content: str, suffix: str) -> None:
    """``put_files`` to a scratch folder; a ``file:`` URI of any form becomes a plain path."""
    sinks.put_files(rows, hadoop_path(spark, path)[1].toUri().getPath() if path.startswith("file:") else path, name, content, suffix)


def _pages(spark, d) -> str:
    """The questions as Markdown files of a folder."""
    path = folder(spark, d, "md")
    rows = read_table(spark, d, "eval_pairs").select(F.concat(F.lit("q"), "item_id").alias("name"), "question")
    _put(spark, rows, path, "name", "question", ".md")
    return path


@query
def markdown_files(spark, d):
    """Files written one per row, read back, sorted and numbered."""
    return sinks.with_row_key(files.markdown_documents(spark, _pages(spark, d)), ["source"], "place")


@query
def named_files(spark, d):
    path = _pages(spark, d)
    names = [f"{path}/q{r['item_id']}.md" for r in read_table(spark, d, "eval_pairs").select("item_id").collect()]  # a stated list of files
    return files.named_documents(spark, names)


@query
def object_list(spark, d):
    return files.list_objects(spark, _pages(spark, d)).select("name", "size")


@query
def object_text(spark, d):
    """A text and a JSON object, put and read back."""
    path, rows = folder(spark, d, "objects"), read_table(spark, d, "eval_pairs").select("item_id", "question")
    sinks.put_json(rows, f"{path}/json")
    sinks.put_text(rows.select(F.concat_ws("\t", "item_id", F.md5("question")).alias("text")), f"{path}/text")
    back = spark.read.schema("item_id bigint, question string").json(f"{path}/json")
    lines = spark.read.text(f"{path}/text").select(F.split("value", "\t").alias("p")).select(F.col("p")[0].cast("long").alias("item_id"), F.col("p")[1].alias("digest"))
    return back.join(lines, "item_id").select("item_id", "question", "digest")


@query
def qa_file(spark, d):
    """The held-out items as one JSON file with an array, read back."""
    item = F.struct("question", "answer", F.col("gold_source").alias("source"), F.lit(None).cast("string").alias("doc"), F.col("gold_source").isNotNull().alias("in_corpus"))
    one = read_table(spark, d, "eval_pairs").agg(F.to_json(F.struct(F.collect_list(item).alias("questions"))).alias("text"))  # always 200 items
    path = folder(spark, d, "qa")
    _put(spark, one.select(F.lit("qa").alias("name"), "text"), path, "name", "text", ".json")
    return files.qa_items(spark, f"{path}/qa.json")


@query
def docx_file(spark, d):
    """The questions as Word files; the lines that end with a question mark."""

    def made(batches):
        for t in batches:
            out = []
            for q in t.column("question").to_pylist():
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    body = (q or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
                    z.writestr("word/document.xml", f"<w:p><w:t>No question here.</w:t></w:p><w:p><w:t>{body}</w:t></w:p>")
                out.append(raw.getvalue())
            yield pa.RecordBatch.from_arrays([t.column("name"), pa.array(out, pa.binary())], names=["name", "content"])

    rows = read_table(spark, d, "eval_pairs").select(F.concat(F.lit("q"), "item_id").alias("name"), "question").mapInArrow(made, "name string, content binary")
    path = folder(spark, d, "docx")
    _put(spark, rows, path, "name", "content", ".docx")
    return files.docx_questions(spark, path).select("source", "question")


@query
def table_writes(spark, d):
    """Recreate, append and stage: a partitioned table written anew, loaded twice, read back as a view."""
    path = folder(spark, d, "table")
    rows = read_table(spark, d, "chunk_lab").select("id", F.lower(text.strip(F.col("strategy"))).alias("strategy"), "embedding")
    rows = rows.where("strategy is not null")
    sinks.recreate(rows, path, ["strategy"], dim=64)
    sinks.append(rows, path, ["strategy"])
    sinks.stage(spark.read.parquet(path), "staged_chunks")
    return spark.table("staged_chunks").groupBy("strategy").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query
def scorecard_file(spark, d):
    """A stored scorecard, upserted twice and read back."""
    path, schema = folder(spark, d, "card"), "model string, n bigint"
    base = read_table(spark, d, "naive_rag").where("model is not null").groupBy("model").agg(F.count("*").alias("n"))
    sinks.recreate(spark.createDataFrame([], schema), path)
    sinks.upsert_table(spark, path, spark.createDataFrame([("minilm", 1), ("other", 2)], schema), "model", schema)
    sinks.upsert_table(spark, path, base, "model", schema)
    return files.read_scorecard(spark, path, schema)


# ------------------------------------------------------------------ citations and articles


@query
def citations(spark, d):
    c = F.concat(F.lit("CP Art. "), F.col("item_id"), F.lit(", Art. 7"))
    return read_table(spark, d, "eval_pairs").select("item_id", text.article_number(c).alias("article"), text.article_number(F.col("question")).alias("none"))


@query
def article_named(spark, d):
    """Whether each document names articles 2 and 14, and 2 with ordinal letters read."""
    t = F.col("text")
    return documents(spark, d).where("text is not null").select(
        "doc_id", text.has_article(t, F.lit(2)).alias("two"), text.has_article(t, F.lit(14)).alias("fourteen"), text.has_article(t, F.lit(2), ordinal_aware=True).alias("two_or_second"))


@query
def article_hits(spark, d):
    """Documents that name articles, dealt to seven questions; question q asks for article 10 q + 1."""
    held = documents(spark, d).where(F.size(text.article_numbers(F.col("text"))) > 0).withColumn("qid", F.col("doc_id") % 7)
    got = held.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id")).cast("long"))
    asked = spark.range(7).select(F.col("id").alias("qid"), (F.col("id") * 10 + 1).cast("string").alias("article"))
    return ev.article_hits(got, asked)


@query
def by_length(spark, d):
    """All documents by length, longest first, numbered."""
    return sinks.with_row_key(_lengths(spark, d).where("n is not null").select("doc_id", F.col("n").cast("long").alias("n")), [F.desc("n"), F.asc("doc_id")], "place")


@query
def unescaped(spark, d):
    t = F.col("text")
    escaped = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("á"), F.lit("&aacute;"))
    return documents(spark, d).where("text is not null").select("doc_id", F.md5(text.unescape_html(escaped)).alias("plain"))


# ------------------------------------------------------------------ tables


@query
def row_keys(spark, d):
    return sinks.with_row_key(read_table(spark, d, "documents").select("doc_id"), ["doc_id"], "row_key")


@query
def ingest_roundtrip(spark, d):
    """Chunks with embeddings, written partitioned by source and read back."""
    rows = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), "text")
    stored = materialize(pipelines.ingest(rows, lambda c: chunkers.fixed(c, 150, 25)), "ingest")
    return stored.groupBy("source").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))


@query
def catalog_probe(spark, d):
    got = files.catalog_probe(spark)
    return got.select("database", (F.length("user") > 0).alias("has_user"), F.col("version").startswith("4.").alias("is_4"))


@query
def synthetic_sentences(spark, d):
    return generators.sentences(spark, 5000, 1)


@query
def synthetic_vectors(spark, d):
    return generators.unit_vectors(spark, 2000, 16, 3).select("id", F.round(vector.norm(F.col("embedding")), 5).alias("norm"))


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def core_sql() -> dict[str, str]:
    from ragstone.plans.sql import SQL

    return dict(SQL)
