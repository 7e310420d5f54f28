"""The register of queries, and the tables that the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import lexical
from corpusmill.settings import Settings
from corpusmill.storage import fingerprint, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SETTINGS = Settings()
SITE = f"https://{SETTINGS.site}"


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL if there is any."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as chunks: the first line is the title, the source the subject and the language the heading."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.concat(F.lit(f"{SITE}/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring_index(t, "\n", 1).alias("title"),
        F.coalesce("source", F.lit("")).alias("subject"),
        F.coalesce("lang", F.lit("")).alias("heading"),
        t.alias("text"),
    )


_INDEXES: dict[tuple, lexical.Index] = {}


def index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The stored index of the corpus. It is built when the first search needs it, and again if the files have changed since."""
    key = (spark.sparkContext.applicationId, *fingerprint(table(spark, sf_dir, "documents")))
    if key not in _INDEXES:
        _INDEXES[key] = lexical.build(corpus(spark, sf_dir))
    return _INDEXES[key]


CORPUS = f"""corpus AS (
  SELECT doc_id AS chunk_id, '{SITE}/' || coalesce(source, '') || '/' || doc_id AS url, split_part(coalesce(text, ''), chr(10), 1) AS title,
    coalesce(source, '') AS subject, coalesce(lang, '') AS heading, coalesce(text, '') AS text FROM documents)"""

#: Questions that the tables lack: about times, with accents, too short.
ASKED = [(-1, "¿Cuándo inició la guerra?"), (-2, "¿En qué año fue la guerra?"), (-3, "¿Cuál fue la fecha exacta?"), (-4, "¿Qué es una célula?"), (-5, " a "), (-6, "¿CUÁNDO fue el día 5 de mayo?")]


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """The rows as SQL."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names}))"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("question"))
    return own.unionByName(literal(spark, ASKED, "qid long, question string"))


QUESTIONS = f"q0 AS (SELECT item_id AS qid, coalesce(text, '') AS question FROM benchmark UNION ALL SELECT qid::BIGINT, question FROM {values(ASKED, 'qid, question')})"


def site_of(url) -> object:
    return F.regexp_extract(url, "^([a-z]+://[^/?#]+)", 1)
