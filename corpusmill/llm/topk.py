"""Exact top-k inner products by Fagin's threshold algorithm over blocks of vectors.

Vectors are dealt to blocks by a hash of the row, so that a repeated id fills no block, and queries by their id; each pair of blocks is one task, so a task's
input is bounded and nothing is broadcast. In a block every dimension has a list of its vectors sorted by value. A query walks a list
from the top where its own component is positive and from the bottom where it is negative; rows that are met are scored in full. The sum over
dimensions of what each list can still add bounds the score of every row not met yet: the walk stops when the k-th best score is
above that bound (an equal score could still win by its smaller id) or no row is left.

Lists are not walked alike: those go deeper whose next row can add most, which lowers the bound by the fewest steps. A short first walk gives a
k-th score, and the k-th score of each query in the first block of rows is known to all others; from such a score follows how deep each list has to
be walked. If that is as many steps as the block has rows, the block is scored whole in one product. How much is scored depends on the
data: little if a few dimensions decide, all of it if all 64 dimensions matter alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.session import ship
from corpusmill.storage import materialize, table

K, SCALE, QUERY_EVERY = 20, 64, 20
BLOCK_ROWS, BLOCK_QUERIES = 4096, 4096
WALKED_AT_ONCE = 64  # queries whose depths are chosen together
MOST_AT_ONCE = 256  # queries whose scores against a whole block are made together
OUT = "query_id long, vec_id long, score long"


def _exact(columns: np.ndarray, most: float) -> np.ndarray:
    """In the smallest type that holds every sum of products exactly."""
    return columns.astype(np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Lists:
    """The sorted lists of a block's dimensions, and their values at some depths, for choosing how deep to walk."""

    def __init__(self, rows: np.ndarray):
        n = len(rows)
        self.up = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
        values = np.take_along_axis(rows.T, self.up, axis=1).astype(np.float64)
        self.depths = np.unique(np.concatenate([np.arange(min(n, 16)), np.geomspace(1, n, 48).astype(int) - 1])) if n else np.zeros(0, int)
        self.top, self.bottom = values[:, n - 1 - self.depths], values[:, self.depths]

    def left(self, queries: np.ndarray) -> np.ndarray:
        """(query, list, depth): what a list (dimension) can still add to a score when it was walked to a depth; falling with the depth."""
        q = queries.astype(np.float64)[:, :, None]
        return np.where(q > 0, q * self.top, q * self.bottom)

    def met(self, q: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Which rows are met by walking each list so many steps."""
        n = self.up.shape[1]
        found = np.zeros(n, dtype=bool)
        for d in np.flatnonzero(steps):
            found[self.up[d, n - steps[d] :] if q[d] > 0 else self.up[d, : steps[d]]] = True
        return found


def _walk(left: np.ndarray, depths: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
    """For each query the steps (query, list) after which no list that was left can add more than a level, and whether there is such a level.

    It is the highest level at which ``enough`` (bounds, steps in all) holds for the query.
    """
    low, high = left.min(axis=(1, 2)) - 1, left.max(axis=(1, 2)) + 1
    steps, found = np.zeros(left.shape[:2], dtype=np.int64), np.zeros(len(left), dtype=bool)
    for _ in range(20):
        level = (low + high) / 2
        at = np.minimum((left > level[:, None, None]).sum(axis=2), len(depths) - 1)
        good = enough(np.take_along_axis(left, at[:, :, None], axis=2).sum(axis=(1, 2)), depths[at].sum(axis=1))
        steps[good] = depths[at[good]]
        found |= good
        low, high = np.where(good, level, low), np.where(good, high, level)
    return steps, found


def threshold_topk(
    rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int = K, floors: np.ndarray | None = None, scored: list | None = None
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (id, ids of its best rows, their scores); integers in and out. Rows with the query's id don't count.

    ``floors`` are scores that ``k`` rows elsewhere have at least, or negative infinity: rows below may be left out. ``scored`` takes how many
    rows were scored for each query.
    """
    n, dims = rows.shape
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1)
    rows, queries = _exact(rows, most), _exact(queries, most)
    slack = most * 1e-12 if rows.dtype == np.int64 else 0.0  # bounds are sums of floats
    lists = Lists(rows)
    out: dict[int, tuple] = {}
    whole = []
    for begin in range(0, len(queries), WALKED_AT_ONCE):
        at = range(begin, min(len(queries), begin + WALKED_AT_ONCE))
        if n <= 8 * k or not dims:
            whole += at
            continue
        left = lists.left(queries[begin : begin + WALKED_AT_ONCE])
        known = np.full(len(at), -np.inf) if floors is None else np.asarray(floors[begin : begin + WALKED_AT_ONCE], dtype=np.float64)
        seen = {}
        if np.isneginf(known).any():
            shallow, _ = _walk(left, lists.depths, lambda bounds, total: total >= 4 * k)
            for j in np.flatnonzero(np.isneginf(known)):
                new = np.flatnonzero(lists.met(queries[begin + j], shallow[j]) & (ids != query_ids[begin + j]))
                scores, best = _best(rows[new] @ queries[begin + j], ids[new], k)
                seen[j] = (new, scores, best)
                known[j] = scores[-1] if len(scores) == k else -np.inf
        steps, found = _walk(left, lists.depths, lambda bounds, total: bounds + slack < known)
        for j, i in enumerate(at):
            if not found[j] or steps[j].sum() >= n:
                whole.append(i)
                continue
            q, own = queries[i], query_ids[i]
            before, scores, best = seen.get(j, (np.zeros(0, int), np.zeros(0, rows.dtype), np.zeros(0, ids.dtype)))
            met = lists.met(q, steps[j]) & (ids != own)
            met[before] = False
            new = np.flatnonzero(met)
            out[i] = (own, *reversed(_best(np.concatenate([scores, rows[new] @ q]), np.concatenate([best, ids[new]]), k)))
            if scored is not None:
                scored.append(len(before) + len(new))
    for begin in range(0, len(whole), MOST_AT_ONCE):
        some = whole[begin : begin + MOST_AT_ONCE]
        for i, scores in zip(some, queries[some] @ rows.T):
            others = ids != query_ids[i]
            out[i] = (query_ids[i], *reversed(_best(scores[others], ids[others], k)))
            if scored is not None:
                scored.append(n)
    return [out[i] for i in range(len(queries))]


def _integers(vectors: pd.Series) -> np.ndarray:
    return np.floor(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) * SCALE).astype(np.int64)


def _block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    floors = queries["floor"].fillna(-np.inf).to_numpy(np.float64)
    found = threshold_topk(_integers(rows["v"]), rows["vec_id"].to_numpy(np.int64), _integers(queries["v"]), queries["vec_id"].to_numpy(np.int64), k, floors)
    return pd.DataFrame(
        {
            "query_id": np.repeat([own for own, _, _ in found], [len(b) for _, b, _ in found]).astype(np.int64),
            "vec_id": np.concatenate([b for _, b, _ in found]).astype(np.int64),
            "score": np.concatenate([s for _, _, s in found]).astype(np.int64),
        }
    )


def _dealt(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, d, salt) of the vectors that take part; the salt is written, so that a row keeps it."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = vectors.select("vec_id", F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)
    return materialize(usable.withColumn("d", F.size("v")).withColumn("salt", F.xxhash64("vec_id", "v", F.monotonically_increasing_id())), "vectors")


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` (vec_id, embedding) for each query.

    Queries are the rows whose vec_id is divisible by ``every``. Vectors that are null or hold null or non-finite components,
    and rows with a null vec_id, take no part. Only vectors of equal length meet; vectors of length zero score zero.
    A repeated vec_id is a candidate as often as it stands there, and asks once, with its least vector. Scores must fit
    in a long. Other columns are not read.
    """
    ship(vectors.sparkSession)
    rows = _rows(vectors)
    asks = rows.where(F.col("vec_id") % every == 0).groupBy("d", "vec_id").agg(F.min("v").alias("v"))
    n_rows, n_asks = rows.count(), rows.where(F.col("vec_id") % every == 0).count()
    row_blocks, ask_blocks = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_asks // BLOCK_QUERIES))
    dealt = materialize(asks.select("d", "vec_id", "v", _dealt("vec_id", ask_blocks).alias("qb")), "asks")
    every = lambda column, blocks: rows.select("d", "vec_id", "v", column.alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(ask_blocks - 1))).alias("qb")).where(blocks)
    pairs = lambda left, right: left.groupBy("d", "qb", "rb").cogroup(right.groupBy("d", "qb", "rb")).applyInPandas(lambda a, b: _block(a, b, k), OUT)
    block = _dealt("salt", row_blocks)
    unknown = dealt.withColumn("floor", F.lit(None).cast("double"))
    found = pairs(unknown.withColumn("rb", F.lit(0)), every(block, F.col("rb") == 0))
    if row_blocks > 1:
        found = materialize(found, "first")
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), F.when(F.abs("floor") < 2.0**53, F.col("floor")).alias("floor"))
        floored = dealt.join(kth, "vec_id", "left").select("d", "vec_id", "v", "qb", "floor", F.explode(F.sequence(F.lit(1), F.lit(row_blocks - 1))).alias("rb"))
        found = found.unionByName(pairs(floored, every(block, F.col("rb") > 0)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.c, r.c)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.c) = len(r.c) WHERE q.vec_id % {QUERY_EVERY} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
