"""Embedders: a text column to an ``array<float>`` of unit length.

Python embedders implement ``Embedder``; ``embed`` runs them in Arrow batches,
one instance per Python worker. The hashing embedder needs no Python at all.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragstone.functions.text import bound, tokens


class Embedder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """``(n, dim)`` float32 with rows of unit length."""


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Token counts in ``dim`` md5 buckets, unit length; null for a text without tokens. Deterministic on any engine."""
    def spread_out(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(found, lambda b: b == i)).cast("double"))

    def unit(counts: Column) -> Column:
        size = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return F.when(size > 0, bound(size, lambda z: F.transform(counts, lambda x: (x / z).cast("float"))))

    buckets = F.transform(tokens(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("long") % dim).cast("int"))
    return bound(bound(buckets, spread_out), unit)


class HashingEmbedder:
    """The Python counterpart of ``hash_embedding``."""

    def __init__(self, dim: int = 64):
        self.name, self.dim = f"hash-{dim}", dim

    def encode(self, texts: list[str]) -> np.ndarray:
        import hashlib
        import re

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for t in re.findall(r"[a-z0-9_]+", text.lower()):
                out[i, int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % self.dim] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class LocalModelEmbedder:
    """A sentence-transformers model, if that library is installed; stays offline unless ``EMBED_ALLOW_DOWNLOAD`` is set."""

    def __init__(self, model: str):
        if not os.environ.get("EMBED_ALLOW_DOWNLOAD"):
            os.environ.setdefault("HF_HUB_OFFLINE", "1")
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError("the local backend needs the optional package sentence-transformers") from e
        self.model, self.name = SentenceTransformer(model), model
        self.dim = self.model.get_sentence_embedding_dimension()

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self.model.encode(texts, normalize_embeddings=True), np.float32)


class RemoteEmbedder:
    """A text-embedding HTTP server: GET /info once, POST /embed in batches, retried with growing pauses."""

    def __init__(self, url: str, retries: int = 3):
        self.url, self.retries = url.rstrip("/"), retries
        info = self._call("/info", None, 10)
        self.name, self.batch = info.get("model_id", "remote"), int(info.get("max_client_batch_size") or 32)
        self.dim = self.encode(["dimension"]).shape[1]

    def _call(self, path: str, body: dict | None, timeout: float):
        data = None if body is None else json.dumps(body).encode()
        for attempt in range(self.retries + 1):
            try:
                req = urllib.request.Request(self.url + path, data=data, headers={"Content-Type": "application/json"})
                with urllib.request.urlopen(req, timeout=timeout) as r:
                    return json.load(r)
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(0.5 * 2**attempt)

    def encode(self, texts: list[str]) -> np.ndarray:
        parts = [self._call("/embed", {"inputs": texts[i : i + self.batch], "normalize": True, "truncate": True}, 60) for i in range(0, len(texts), self.batch)]
        return np.asarray([v for p in parts for v in p], np.float32)


# Short names of models.
ALIASES = {
    "minilm": "sentence-transformers/all-MiniLM-L6-v2",
    "mpnet": "sentence-transformers/all-mpnet-base-v2",
    "bge-small": "BAAI/bge-small-en-v1.5",
    "bge-base": "BAAI/bge-base-en-v1.5",
}
# Names that mean the remote server.
REMOTE_NAMES = ("tei", "remote", "gpu", "rtx")


def get_embedder(name: str, url: str | None = None) -> Embedder:
    """By alias, ``hash-<dim>``, one of the remote names (needs ``url`` or ``TEI_URL``), or a model id."""
    key = name.lower()
    if key.startswith("hash"):
        return HashingEmbedder(int(key.partition("-")[2] or 64))
    if key in REMOTE_NAMES:
        return RemoteEmbedder(url or os.environ["TEI_URL"])
    return LocalModelEmbedder(ALIASES.get(key, name))


_LOADED: dict = {}


def embed(df: DataFrame, make: Callable[[], Embedder], text_col: str = "text", out: str = "embedding", key: str = "default") -> DataFrame:
    """``df`` with the embedding of ``text_col``; ``make`` runs once per Python worker. Null texts get null."""
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _LOADED.get(key) or _LOADED.setdefault(key, make())
        for t in batches:
            texts = t.column(text_col).to_pylist()
            known = [i for i, x in enumerate(texts) if x is not None]
            got: list = [None] * len(texts)
            if known:
                for i, v in zip(known, model.encode([texts[i] for i in known])):
                    got[i] = v
            yield pa.RecordBatch.from_arrays([t.column(c) for c in keep] + [pa.array(got, pa.list_(pa.float32()))], names=[*keep, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` array<float>")
