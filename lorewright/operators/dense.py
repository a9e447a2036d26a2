"""The dense index: what is embedded, its store, what of it is stale, the queue of entries that wait, and vector search.

An embedder is a function of a list of texts that gives as many vectors of DIM numbers; `hashed` is one that needs no network.
Stores are tables (entry_id, embedding, content_hash, model_revision).
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewright.functions.text import content_hash
from lorewright.operators import search
from lorewright.plans.lineage import cut, stored

DIM, BATCH, LONGEST, TRIES = 64, 16, 512, 3
#: Waiting entries from which the queue warns, and at which it takes no more.
WARN_DEPTH, HARD_DEPTH = 5000, 20000
STORE_SCHEMA = "entry_id string, embedding array<float>, content_hash string, model_revision string"
Embedder = Callable[[list[str]], list[list[float]]]


def embed_text(body_chars: int = 2000) -> Column:
    """What is embedded of an entry: title, tags, aliases, terms and the body's start, a line each, empty ones left out."""
    parts = [F.col("title"), F.array_join("tags", " "), F.array_join("aliases", " "), F.array_join("search_terms", " "), F.substring("body", 1, body_chars)]
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def text_hash() -> Column:
    return content_hash(embed_text())


def tokens_estimated(text: str) -> list[str]:
    """Words of ASCII letters and digits, and every other character but spaces, as a tokenizer would about count them."""
    return re.findall(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]", text)


def truncated(text: str, most: int = LONGEST) -> str:
    """The text up to the end of its most-th estimated token."""
    for i, found in enumerate(re.finditer(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]", text), 1):
        if i == most:
            return text[: found.end()]
    return text


def hashed(texts: list[str], dim: int = DIM) -> list[list[float]]:
    """Unit vectors of hashed words, the same for the same text everywhere."""
    import zlib

    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts, strict=True):
        for word in tokens_estimated(text.lower()):
            h = zlib.crc32(word.encode())
            row[h % dim] += 1 if h >> 16 & 1 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norms, 1e-9)).tolist()


def embedded(entries: DataFrame, embedder: Embedder = hashed, revision: str = "hashed-1", dim: int = DIM, pause: float = 0.0, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(store rows, failures (entry_id, error)) of entries, BATCH texts a call, TRIES calls each. Vectors that held (a store)
    has for the same entry and text are taken from it and not worked out. A vector of another length than dim is a failure."""
    rows = entries.select(F.col("id").alias("entry_id"), embed_text().alias("text"), text_hash().alias("content_hash"))
    known = None
    if held is not None:
        known = held.join(rows.select("entry_id", "content_hash"), ["entry_id", "content_hash"], "left_semi").select("entry_id", "embedding", "content_hash", "model_revision")
        rows = rows.join(known.select("entry_id"), "entry_id", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float] | None] = []
            errors: list[str | None] = []
            for a in range(0, len(frame), BATCH):
                texts = [truncated(t) for t in frame["text"].iloc[a : a + BATCH]]
                found, error = None, None
                for turn in range(TRIES):
                    try:
                        found = embedder(texts)
                        if any(len(v) != dim for v in found):
                            found, error = None, "wrong dimension"
                        break
                    except Exception as e:  # an embedder may fail in any way; its rows are reported
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause * 2**turn)
                vectors += found or [None] * len(texts)
                errors += [None if found else error] * len(texts)
            yield pd.DataFrame({"entry_id": frame["entry_id"], "embedding": vectors, "content_hash": frame["content_hash"], "model_revision": revision, "error": errors})

    done = stored(rows.mapInPandas(run, STORE_SCHEMA + ", error string"))  # read twice, and an embedder may cost by the call
    good = done.where("error is null").drop("error")
    return (good if known is None else good.unionByName(known)), done.where("error is not null").select("entry_id", "error")


def loaded(store: DataFrame, dim: int = DIM) -> DataFrame:
    """The store's vectors of the right length."""
    return store.where(F.size("embedding") == dim)


def stale(entries: DataFrame, store: DataFrame) -> DataFrame:
    """(id) of active entries whose vector is missing or of another text."""
    now = entries.where("status <> 'archived'").select("id", text_hash().alias("now"))
    met = now.join(store.select(F.col("entry_id").alias("id"), "content_hash"), "id", "left")
    return met.where(F.col("content_hash").isNull() | (F.col("content_hash") != F.col("now"))).select("id")


def upserted(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store with rows in place of those of their entries."""
    return store.join(rows.select("entry_id"), "entry_id", "left_anti").unionByName(rows.select(*store.columns))


def enqueued(queue: DataFrame, new: DataFrame, warn: int = WARN_DEPTH, hard: int = HARD_DEPTH) -> tuple[DataFrame, str]:
    """The queue (entry_id, queued_at) with new rows behind it, and its state: ok, warn, or full (nothing was taken)."""
    depth = queue.count()
    if depth >= hard:
        return queue, "full"
    return queue.unionByName(new.select(*queue.columns)), "warn" if depth >= warn else "ok"


def drained(queue: DataFrame, entries: DataFrame, store: DataFrame, most: int = 100, embedder: Embedder = hashed) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(store, queue, counts) after the first `most` waiting ids, each once and by age, were worked on: missing, archived and
    unchanged ones are skipped, failed ones stay."""
    waiting = queue.groupBy("entry_id").agg(F.min("queued_at").alias("queued_at"))
    taken = cut(waiting.orderBy("queued_at", "entry_id").limit(max(0, most)))
    wanted = stale(entries, store).join(taken.select(F.col("entry_id").alias("id")), "id", "left_semi")
    rows, failures = embedded(entries.join(wanted, "id", "left_semi"), embedder)
    handled = taken.join(failures.select("entry_id"), "entry_id", "left_anti")
    processed, ok, failed = taken.count(), rows.count(), failures.count()
    left = waiting.join(handled.select("entry_id"), "entry_id", "left_anti").select(*queue.columns)
    return upserted(store, rows), left, {"processed": processed, "ok": ok, "skipped": processed - ok - failed, "failed": failed}


def rebuilt(entries: DataFrame, store: DataFrame, done: DataFrame | None = None, only_stale: bool = True, embedder: Embedder = hashed) -> tuple[DataFrame, DataFrame]:
    """(store, failures) after all, or all stale, entries were embedded, but for those that an interrupted run had done
    (entry_id)."""
    wanted = stale(entries, store) if only_stale else entries.where("status <> 'archived'").select("id")
    if done is not None:
        wanted = wanted.join(done.select(F.col("entry_id").alias("id")), "id", "left_anti")
    rows, failures = embedded(entries.join(wanted, "id", "left_semi"), embedder)
    return upserted(store, rows), failures


def enabled(store: DataFrame, embedder: Embedder | None) -> bool:
    """Whether search has a vector route: an embedder, and vectors."""
    return embedder is not None and not store.isEmpty()


def dense_hits(store: DataFrame, query: str, limit: int, embedder: Embedder = hashed, weight: float = 1.5) -> DataFrame:
    """(id, score) of the entries nearest to the query's text: positive cosines times weight."""
    (vector,) = embedder([query])
    return search.nearest(loaded(store, len(vector)).select(F.col("entry_id").alias("id"), "embedding"), vector, limit, weight)
