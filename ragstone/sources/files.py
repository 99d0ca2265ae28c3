"""Reading document collections from any Hadoop file system."""

from __future__ import annotations

import html
import io
import re
import zipfile

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragstone.functions.text import file_name, file_stem


def _whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def markdown_documents(spark: SparkSession, folder: str, stem: bool = True, trimmed: bool = False) -> DataFrame:
    """``(source, text)`` of every ``*.md`` file, whole file = one row, in the order of the sources. ``source`` is the stem or the file name."""
    rows = _whole(spark, f"{folder.rstrip('/')}/*.md")
    text = F.regexp_replace("text", "(?U)^\\s+|\\s+$", "") if trimmed else F.col("text")
    return rows.select((file_stem if stem else file_name)(F.col("path")).alias("source"), text.alias("text")).orderBy("source")


def named_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(source, text)`` of a fixed list of files."""
    return _whole(spark, paths).select(file_name(F.col("path")).alias("source"), "text")


QA_SCHEMA = "questions array<struct<question string, answer string, source string, doc string, in_corpus boolean>>"


def qa_items(spark: SparkSession, path: str) -> DataFrame:
    """``(question, answer, source, doc, in_corpus)`` of a JSON file with an array ``questions``."""
    return spark.read.schema(QA_SCHEMA).json(path, multiLine=True).selectExpr("inline(questions)")


def docx_questions(spark: SparkSession, path: str) -> DataFrame:
    """``(source, line_no, question)``: lines of Word files that end with a question mark. A file that is not a Word file has none."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for t in batches:
            src, no, out = [], [], []
            for p, raw in zip(t.column("path").to_pylist(), t.column("content").to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        xml = z.read("word/document.xml").decode("utf-8", "replace")
                except (zipfile.BadZipFile, KeyError):
                    continue
                plain = html.unescape(re.sub(r"<[^>]+>", "", xml.replace("</w:p>", "\n")))
                for i, line in enumerate(x.strip() for x in plain.split("\n")):
                    if line.endswith("?"):
                        src.append(p)
                        no.append(i)
                        out.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(no, pa.int32()), pa.array(out, pa.string())], names=["path", "line_no", "question"])

    return files.mapInArrow(run, "path string, line_no int, question string").select(file_name(F.col("path")).alias("source"), "line_no", "question")


def pdf_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(source, text)`` of PDF files as Markdown, by the optional package pymupdf4llm. No files: no rows."""
    try:
        import pymupdf4llm  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional package pymupdf4llm") from e

    def run(batches):
        import pymupdf
        import pymupdf4llm

        for t in batches:
            texts = [pymupdf4llm.to_markdown(pymupdf.open(stream=raw, filetype="pdf")) for raw in t.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, text string").select(file_stem(F.col("path")).alias("source"), "text")


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``(name, modified, size)`` of the files under a root (any Hadoop FS, S3A included); a missing root gives no rows."""
    empty = spark.createDataFrame([], "name string, modified string, size bigint")
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    except AnalysisException:
        return empty
    base = re.sub(r"^[a-z0-9]+:/+", "", root.rstrip("/")).lstrip("/")
    name = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", ""), f"^/*\\Q{base}\\E/", "")
    return found.select(name.alias("name"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"), F.col("length").alias("size")).where(F.col("name").startswith(prefix))


def get_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def get_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


SCORECARD = "model string, dim int, n_chunks bigint, recall_at_1 double, recall_at_3 double, recall_at_5 double, mrr double, ndcg_at_5 double"


def read_scorecard(spark: SparkSession, path: str, schema: str = SCORECARD) -> DataFrame:
    """The stored scorecard, or an empty one of the same schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def catalog_probe(spark: SparkSession) -> DataFrame:
    """One row: database, user and version of the session."""
    return spark.sql("select current_database() as database, current_user() as user, version() as version")
