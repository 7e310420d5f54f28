"""Embeddings: what is stored, what is pending, and exact semantic top-k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.models import Embedder
from corpusmill.session import ship
from corpusmill.storage import materialize

TOP = 20
LEAST_NORM = 1e-12
BLOCK = 4096
SIMILARITY = "qid long, chunk_id long, sim double"


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(vector: Column) -> Column:
    """At length one; the norm is at least LEAST_NORM."""
    n = F.greatest(norm(vector), F.lit(LEAST_NORM))
    return F.transform(vector, lambda x: x.cast("double") / n)


def dims(vectors: DataFrame) -> DataFrame:
    """One row: how many vectors and lengths there are, and whether they agree."""
    return vectors.agg(F.count("vector").alias("n_vectors"), F.count_distinct(F.size("vector")).alias("n_dims"), F.max(F.size("vector")).alias("dims")).withColumn("consistent", F.col("n_dims") <= 1)


def scan(chunks: DataFrame, documents: DataFrame, model: str) -> DataFrame:
    """Chunks of active documents with a vector of ``model``."""
    live = documents.where("active").select("url", "title", "subject")
    return chunks.where(F.col("embedding").isNotNull() & (F.col("embedding_model") == model)).join(live, "url")


def pending(chunks: DataFrame, documents: DataFrame, model: str, limit: int | None = None, order: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Chunks of active documents without a vector of ``model``, null-safe; with ``limit`` the first so many in ``order``."""
    live = documents.where("active").select("url", "title", "subject")
    rows = chunks.where(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))).join(live, "url")
    return rows if limit is None else rows.orderBy(*order).limit(max(0, limit))


def remaining(chunks: DataFrame, documents: DataFrame, model: str) -> DataFrame:
    """One row: how many chunks are pending."""
    return pending(chunks, documents, model).agg(F.count("*").alias("remaining"))


def embed(rows: DataFrame, text: str, embedder: Embedder, batch: int = 8) -> DataFrame:
    """``rows`` with the vector of column ``text``; the embedder is called for ``batch`` texts at a time."""
    ship(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        out = [v for i in range(0, len(texts), batch) for v in embedder.embed(texts.iloc[i : i + batch].tolist())]
        if len(out) != len(texts):
            raise ValueError("the embedder gave another number of vectors")
        return pd.Series([np.asarray(v, dtype=np.float32) for v in out])

    return rows.withColumn("vector", vectors(text))


def _similar(k: int):
    def block(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asks) or not len(rows):
            return pd.DataFrame({"qid": [], "chunk_id": [], "sim": []}).astype({"qid": "int64", "chunk_id": "int64", "sim": "float64"})
        a, b = (np.stack([np.asarray(v, dtype=np.float64) for v in x["v"]]) for x in (asks, rows))
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), LEAST_NORM) for x in (a, b))
        ids, out = rows["chunk_id"].to_numpy(), []
        for qid, sims in zip(asks["qid"], np.round(a @ b.T, 9)):
            near = np.flatnonzero(sims >= np.partition(sims, -k)[-k]) if len(sims) > k else np.arange(len(sims))  # ties included
            best = near[np.lexsort((ids[near], -sims[near]))[:k]]
            out.append(pd.DataFrame({"qid": qid, "chunk_id": ids[best], "sim": sims[best]}))
        return pd.concat(out)

    return block


def semantic_topk(questions: DataFrame, vectors: DataFrame, k: int = TOP) -> DataFrame:
    """(qid, chunk_id, sim, semantic_rank): the ``k`` vectors (chunk_id, vector) most like each question's (qid, vector).

    Exact: blocks of questions meet blocks of vectors in tasks of a fixed size, whose best are merged. Equal similarities
    (to 9 places) go by chunk_id. Null vectors take no part.
    """
    ship(vectors.sparkSession)
    asks = materialize(questions.where("vector IS NOT NULL").select("qid", F.col("vector").alias("v")), "asks")
    rows = materialize(vectors.where("vector IS NOT NULL").select("chunk_id", F.col("vector").alias("v")), "rows")
    n_a, n_r = (max(1, -(-x.count() // BLOCK)) for x in (asks, rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asks.select("qid", "v", F.pmod(F.xxhash64("qid"), F.lit(n_a)).alias("a"), every(n_r).alias("r"))
    right = rows.select("chunk_id", "v", every(n_a).alias("a"), F.pmod(F.xxhash64("chunk_id"), F.lit(n_r)).alias("r"))
    left, right = (x.withColumns({"a": F.col("a").cast("int"), "r": F.col("r").cast("int")}) for x in (left, right))
    found = left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInPandas(_similar(k), SIMILARITY)
    best = Window.partitionBy("qid").orderBy(F.desc("sim"), "chunk_id")
    return found.withColumn("semantic_rank", F.row_number().over(best)).where(F.col("semantic_rank") <= k)
