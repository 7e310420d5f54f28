"""Hybrid search: reciprocal-rank fusion of lexical and semantic hits, reranking, and the evidence gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import temporal

# Constants of the fusion, the penalty and the gate.
RRF, SEMANTIC_WEIGHT, LEXICAL_WEIGHT = 60, 1.2, 1.0
PENALISED = ["/ejercicio", "/actividad", "/bibliografia", "/creditos"]
PENALTY = 0.65
PER_URL = 2
GOOD_RANK, GOOD_SIM, ENOUGH_SIM = 5, 0.25, 0.38


def fuse(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """(qid, chunk_id, sim, semantic_rank, lexical_rank, rrf) of hits by either way."""
    both = semantic.select("qid", "chunk_id", "sim", "semantic_rank").join(lexical.select("qid", "chunk_id", "lexical_rank"), ["qid", "chunk_id"], "full")
    share = lambda weight, rank: F.coalesce(F.lit(weight) / (F.lit(float(RRF)) + F.col(rank)), F.lit(0.0))
    return both.withColumn("rrf", F.round(share(SEMANTIC_WEIGHT, "semantic_rank") + share(LEXICAL_WEIGHT, "lexical_rank"), 12))


def evidence(title: str = "title", heading: str = "heading", text: str = "text") -> Column:
    return F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in (title, heading, text)))


def rerank(fused: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fused hits with their chunk and score: the bonus for temporal evidence is added, then penalised URLs are scaled down.

    ``chunks`` are those with a vector of the current model; hits on others are dropped.
    """
    rows = fused.join(chunks, "chunk_id").join(questions.select("qid", "question"), "qid")
    penalised = F.lower("url").rlike("|".join(PENALISED))
    score = (F.col("rrf") + temporal.bonus(F.col("question"), evidence())) * F.when(penalised, PENALTY).otherwise(1.0)
    return rows.withColumn("score", F.round(score, 12))


def best(reranked: DataFrame, k: int, per_url: int = PER_URL) -> DataFrame:
    """The ``k`` best for each question, at most ``per_url`` of one URL, with their rank."""
    order = [F.desc("score"), F.col("semantic_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "chunk_id"]
    capped = reranked.withColumn("of_url", F.row_number().over(Window.partitionBy("qid", "url").orderBy(*order))).where(F.col("of_url") <= per_url)
    return capped.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k).drop("of_url")


def search(questions: DataFrame, chunks: DataFrame, semantic: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Hybrid hits for all questions at once. Without any vector there are none, whatever lexical search finds."""
    return best(rerank(fuse(semantic, lexical), questions, chunks), k)


def gate(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, sufficient): whether the hits of a question are evidence enough to answer it.

    A question about time needs a date, or for a full date one such, in a hit. Then either a hit among the first lexical ranks is
    similar, or one is very similar.
    """
    asks = questions.select("qid", "question")
    text = evidence()
    sim = F.coalesce("sim", F.lit(0.0))
    seen = hits.groupBy("qid").agg(
        F.bool_or(temporal.found(text, temporal.FULL_DATE)).alias("dated"),
        F.bool_or(temporal.found(text, temporal.EVIDENCE)).alias("timed"),
        F.bool_or(F.coalesce((F.col("lexical_rank") <= GOOD_RANK) & (sim >= GOOD_SIM), F.lit(False))).alias("matched"),
        F.max(sim).alias("best_sim"),
    )
    needs = F.when(~temporal.found(F.col("question"), temporal.QUESTION), True).when(temporal.found(F.col("question"), temporal.DATE_QUESTION), F.col("dated")).otherwise(F.col("timed"))
    return asks.join(seen, "qid", "left").select("qid", F.coalesce(needs & (F.col("matched") | (F.col("best_sim") >= ENOUGH_SIM)), F.lit(False)).alias("sufficient"), "best_sim")
