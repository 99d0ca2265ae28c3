"""Sources, sinks, generators, streaming and the driver's entry."""

import http.server
import json
import threading
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ragstone.functions.embedders import RemoteEmbedder
from ragstone.session import clear_scratch, materialize, shared_dir
from ragstone.sources import files, generators, sinks
from ragstone.streaming import ingest


def test_markdown_and_named_files(spark, tmp_path):
    (tmp_path / "b.x.md").write_text(" two \n")
    (tmp_path / "a.md").write_text("one\nline")
    (tmp_path / "c.txt").write_text("no")
    assert {(r["source"], r["text"]) for r in files.markdown_documents(spark, str(tmp_path)).collect()} == {("a", "one\nline"), ("b.x", " two \n")}
    assert {(r["source"], r["text"]) for r in files.markdown_documents(spark, str(tmp_path), stem=False, trimmed=True).collect()} == {("a.md", "one\nline"), ("b.x.md", "two")}
    assert files.named_documents(spark, [str(tmp_path / "c.txt")]).first()["text"] == "no"


def test_qa_items(spark, tmp_path):
    qs = [{"question": "q1", "answer": "a", "source": "CP Art. 14", "doc": "d", "in_corpus": True}, {"question": "q2", "answer": "b", "source": "x", "doc": None, "in_corpus": False}]
    (tmp_path / "qa.json").write_text(json.dumps({"name": "n", "questions": qs}, indent=2))
    got = files.qa_items(spark, str(tmp_path / "qa.json")).orderBy("question").collect()
    assert [r["in_corpus"] for r in got] == [True, False] and got[1]["doc"] is None


def test_docx(spark, tmp_path):
    xml = "<w:p><w:t>What is A &amp; B?</w:t></w:p><w:p><w:t>Not a question.</w:t></w:p><w:p>¿Qué es? </w:p>"
    with zipfile.ZipFile(tmp_path / "q.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "bad.docx").write_text("no zip")
    got = [r["question"] for r in files.docx_questions(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == ["What is A & B?", "¿Qué es?"]


def test_pdf_needs_its_package(spark, tmp_path):
    with pytest.raises(RuntimeError):
        files.pdf_documents(spark, str(tmp_path))


def test_objects(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "f.json").write_text('{"a": 1}')
    (tmp_path / "g.txt").write_text("hello")
    got = {r["name"]: r["size"] for r in files.list_objects(spark, str(tmp_path)).collect()}
    assert got == {"x/y/f.json": 8, "g.txt": 5}
    assert files.list_objects(spark, str(tmp_path), "x/").count() == 1 and files.list_objects(spark, str(tmp_path / "none")).count() == 0
    assert files.get_text(spark, str(tmp_path / "g.txt")).first()[0] == "hello" and files.get_json(spark, str(tmp_path / "x/y/f.json")).first()["a"] == 1


def test_catalog_probe(spark):
    assert files.catalog_probe(spark).first()["version"].startswith("4.")


def test_recreate_append_and_dim(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "b", None)], "id bigint, s string, embedding array<float>")
    sinks.recreate(df, p, ["s"], dim=2)
    sinks.append(df, p, ["s"])
    assert spark.read.parquet(p).count() == 4
    sinks.recreate(df, p, dim=2)
    assert spark.read.parquet(p).count() == 2
    with pytest.raises(Exception, match="has not 3"):
        sinks.recreate(df, str(tmp_path / "u"), dim=3)


def test_row_keys_are_dense(spark):
    df = spark.range(0, 1000, 7).select((F.col("id") * 3 % 1000).alias("x")).repartition(5)
    got = [(r["x"], r["id"]) for r in sinks.with_row_key(df, ["x"], buckets=6).orderBy("id").collect()]
    assert [i for _, i in got] == list(range(1, len(got) + 1)) and [x for x, _ in got] == sorted(x for x, _ in got)
    assert sinks.with_row_key(df.limit(0), ["x"]).count() == 0


def test_row_keys_of_many_rows_and_a_hot_value(spark):
    """150,000 rows, a third of them with one value: more than the range sampler sees."""
    df = spark.range(150_000).selectExpr("case when id % 3 = 0 then -1 else id * 7919 % 150000 end as x", "id as row")
    got = sinks.with_row_key(df, ["x"], "key", buckets=16)
    assert got.agg(F.countDistinct("key"), F.min("key"), F.max("key")).first()[:] == (150_000, 1, 150_000)
    wrong = got.withColumn("before", F.lag("x").over(Window.orderBy("key"))).where("before > x")
    assert wrong.count() == 0


def test_remote_embedder_against_a_stub_server():
    class Stub(http.server.BaseHTTPRequestHandler):
        def answer(self, body):
            raw = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            self.answer({"model_id": "stub", "max_client_batch_size": 2})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["inputs"]
            self.answer([[float(len(x)), 1.0] for x in asked] if len(asked) <= 2 else None)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        e = RemoteEmbedder(f"http://127.0.0.1:{server.server_port}/")
        assert (e.name, e.dim, e.batch) == ("stub", 2, 2)
        assert e.encode(["a", "bb", "ccc"]).tolist() == [[1, 1], [2, 1], [3, 1]]
    finally:
        server.shutdown()


def test_upsert_table(spark, tmp_path):
    p, schema = str(tmp_path / "card"), "model string, mrr double"
    row = lambda *r: spark.createDataFrame([r], schema)
    sinks.upsert_table(spark, p, row("a", 0.1), "model", schema)
    sinks.upsert_table(spark, p, row("b", 0.2), "model", schema)
    got = sinks.upsert_table(spark, p, row("a", 0.9), "model", schema)
    assert {tuple(r) for r in got.collect()} == {("a", 0.9), ("b", 0.2)}
    assert files.read_scorecard(spark, str(tmp_path / "none")).count() == 0


def test_file_sinks_and_display(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\ny"), ("b", None)], "name string, text string")
    sinks.put_files(df, str(tmp_path / "o"), "name", "text")
    assert (tmp_path / "o" / "a.md").read_text() == "x\ny" and (tmp_path / "o" / "b.md").read_text() == ""
    sinks.put_json(df, str(tmp_path / "j"))
    sinks.put_text(df.where("text is not null"), str(tmp_path / "tx"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    r = spark.createDataFrame([(1, 0.123456, "t" * 300)], "rank int, distance double, text string")
    assert len(sinks.display_rows(r).first()["snippet"]) == 240
    assert sinks.stage(df, "staged").count() == 2 and spark.table("staged").count() == 2
    spark.catalog.uncacheTable("staged")


def test_generators(spark):
    df = generators.sentences(spark, 19_200, 3)
    assert df.select("text").distinct().count() == 19_200 == generators.CAPACITY
    with pytest.raises(ValueError):
        generators.sentences(spark, 19_201)
    a, b = generators.sentences(spark, 500, 1), generators.sentences(spark, 500, 2)
    assert generators.held_out(b, a).join(a, "text").count() == 0
    v = generators.unit_vectors(spark, 50, 8, 1)
    assert v.where(F.abs(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x) - 1) > 1e-5).count() == 0
    assert v.repartition(3).orderBy("id").collect() == generators.unit_vectors(spark, 50, 8, 1).orderBy("id").collect()


def test_shared_folder_follows_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialize(spark.range(3)).count() == 3
    clear_scratch(spark)
    assert materialize(spark.range(4)).count() == 4


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("one two three")
    for n in (1, 2):
        q = ingest.start(ingest.chunk_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (src / "b.md").write_text("four five")


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
