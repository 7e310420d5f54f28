"""Quality rules: base statistics, and a hashed n-gram log-likelihood ratio of trusted to raw text.

Trusted documents are those that ``labels`` calls good and not toxic; raw are all documents. Word unigrams and bigrams (ASCII
lower case) are counted in ``BUCKETS`` hashed buckets each, over all documents. A document's score of an order is the mean over
its n-grams of log((t + PRIOR) / (e + PRIOR)): ``t`` is the bucket's trusted count, ``e`` the raw count on the scale of
the trusted total, both without the document itself. A trusted document must not vouch for itself: the thresholds are the
``QUANTILE`` quantiles of the trusted documents' own scores, found with a histogram, so nearly all text like theirs is kept
at any size of corpus. A document stays if it passes the base rules and is not below the threshold of either order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from corpusmill.llm.text import SPACE, encoded, word_blocks
from corpusmill.session import ship
from corpusmill.storage import all_columns, bounded, free_names, is_broadcast, materialize, table

BUCKET_BITS = 18
BUCKETS, SLICES = 1 << BUCKET_BITS, 64
PRIOR = 5.0
QUANTILE = 0.002
MOST_TRUSTED = 4_000_000  # ids that are broadcast
STEPS = 1000  # of the histogram, in each unit of score
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; per cent of words in repeated 3-word windows
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCORES = ["score_1", "score_2", "own_1", "own_2"]
KIND = StructType([StructField(c, LongType()) for c in BASE] + [StructField(c, DoubleType()) for c in SCORES])
_SYMBOLS = b"#*$%&|<>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_ids(raw: bytes) -> tuple[dict[bytes, int], np.ndarray]:
    """Numbers for the distinct words in order of appearance, and the text as such numbers."""
    known: dict[bytes, int] = {}
    parts = []
    for words in word_blocks(raw):
        new = [w for w in dict.fromkeys(words) if w not in known]
        known.update(zip(new, count(len(known))))
        parts.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
    return known, np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """How many words lie in 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    if distinct < 1 << 21:
        windows = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def base_statistics(text: str | None, raw: bytes, ids: np.ndarray, distinct: int) -> tuple[int, ...]:
    seen: set[bytes] = set()
    duplicates = 0
    for line in raw.split(b"\n"):
        if line in seen:
            duplicates += 1
        elif line.strip(SPACE):
            seen.add(line)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACE)))
    return len(ids), chars, len(raw) - len(raw.translate(None, _SYMBOLS)), duplicates, repeated_words(ids, distinct)


def ngram_buckets(known: dict[bytes, int], ids: np.ndarray) -> list[np.ndarray]:
    """The buckets of the unigrams and of the bigrams."""
    h = np.fromiter((zlib.crc32(w.lower()) for w in known), dtype=np.uint64, count=len(known))[ids]
    pairs = (h[:-1] * _ODD) ^ (h[1:] * np.uint64(0xD6E8FEB86659FD93))
    return [((x * _ODD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) for x in (h, pairs ^ (pairs >> np.uint64(29)))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (raw or trusted, order, bucket) of a task's documents in slices, so that sums of slices can be made apart."""
    totals = np.zeros((2, 2, BUCKETS), dtype=np.int64)
    for b in batches:
        for text, is_trusted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for order, buckets in enumerate(ngram_buckets(*word_ids(encoded(text)))):
                for which in range(1 + is_trusted):
                    if len(buckets) > BUCKETS // 8:
                        totals[which, order] += np.bincount(buckets, minlength=BUCKETS)
                    else:
                        np.add.at(totals[which, order], buckets, 1)
    yield from _slices(dict(enumerate(totals.reshape(SLICES, -1))))


def _slices(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array(parts.keys(), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts.values()], pa.binary())], ["slice", "counts"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts = np.frombuffer(zlib.decompress(x), dtype=np.int64)
            parts[k] = parts[k] + counts if k in parts else counts
    yield from _slices(parts)


def ngram_counts(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts (order, bucket) over all rows of ``docs`` (doc_id, text), and over those of ``trusted`` (doc_id).

    Their size is fixed, whatever the corpus. One pass over the texts counts both if the trusted ids may be broadcast; else all are counted
    where they lie, and the trusted ones apart.
    """
    texts = docs.select("doc_id", "text")
    if is_broadcast(trusted):
        return _counted(texts.join(trusted.withColumn("is_trusted", F.lit(True)), "doc_id", "left"))
    raw, _ = _counted(texts.withColumn("is_trusted", F.lit(False)))
    target, _ = _counted(texts.join(trusted, "doc_id", "left_semi").withColumn("is_trusted", F.lit(False)))
    return raw, target


def _counted(flagged: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    kind = "slice int, counts binary"
    texts = flagged.select("text", F.coalesce("is_trusted", F.lit(False)).alias("is_trusted"))
    rows = texts.mapInArrow(_count, kind).repartition(SLICES, "slice").mapInArrow(_sum, kind).collect()  # SLICES rows of a fixed size
    parts = {r["slice"]: np.frombuffer(zlib.decompress(bytes(r["counts"])), dtype=np.int64) for r in rows}
    empty = np.zeros(4 * BUCKETS // SLICES, dtype=np.int64)
    return tuple(np.concatenate([parts.get(k, empty) for k in range(SLICES)]).reshape(2, 2, BUCKETS))


def ratio(buckets: np.ndarray, trusted: np.ndarray, raw: np.ndarray, n_trusted: int, n_raw: int) -> tuple[float, float]:
    """The mean log ratio of n-grams without this document, as one that isn't trusted and as one that is."""
    if not len(buckets) or not n_trusted:
        return 0.0, 0.0
    kinds, own = np.unique(buckets, return_counts=True)
    t, r, rest = trusted[kinds], raw[kinds] - own, max(1, n_raw - len(buckets))
    base, expected = np.log(t + PRIOR), np.log(r * (n_trusted / rest) + PRIOR)
    as_other = float((own * (base - expected)).sum() / len(buckets))
    t, expected = np.maximum(0, t - own), np.log(r * (max(0, n_trusted - len(buckets)) / rest) + PRIOR)
    return as_other, float((own * (np.log(t + PRIOR) - expected)).sum() / len(buckets))


def scorer(spark: SparkSession, raw: np.ndarray, trusted: np.ndarray):
    """A column function: text to a struct of BASE and SCORES."""
    shared = spark.sparkContext.broadcast((trusted.astype(np.float64), raw.astype(np.float64), trusted.sum(axis=1).tolist(), raw.sum(axis=1).tolist()))

    @F.pandas_udf(KIND)
    def scored(texts: pd.Series) -> pd.DataFrame:
        t, r, n_t, n_r = shared.value
        rows = []
        for text in texts:
            bytes_ = encoded(text)
            known, ids = word_ids(bytes_)
            (a, own_a), (b, own_b) = (ratio(x, t[k], r[k], n_t[k], n_r[k]) for k, x in enumerate(ngram_buckets(known, ids)))
            rows.append((*base_statistics(text, bytes_, ids, len(known)), a, b, own_a, own_b))
        return pd.DataFrame(rows, columns=BASE + SCORES)

    return scored


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids with labels of which all say good and none toxic."""
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0").select("doc_id")


def _passes(kind: str, least: list[float]) -> Column:
    """Whether a row with BASE and SCORES passes, with its scores as ``score`` (another document) or ``own`` (a trusted one)."""
    return ~_failed() & (F.col(f"{kind}_1") >= least[0]) & (F.col(f"{kind}_2") >= least[1])


def _failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _thresholds(rows: DataFrame, trusted: DataFrame) -> list[float]:
    """The least score of each order: quantiles over the trusted documents of ``rows`` (doc_id, BASE, SCORES) that pass the base rules."""
    own = rows.join(trusted, "doc_id", "left_semi").where(~_failed()).select(F.posexplode(F.array("own_1", "own_2")).alias("order", "x"))
    cell = F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("x"))) * STEPS)
    bins = own.groupBy("order", cell.alias("bin")).count().collect()  # at most 40 * STEPS each
    least = []
    for order in (0, 1):
        counts = sorted((r["bin"], r["count"]) for r in bins if r["order"] == order)
        need, upto = QUANTILE * sum(n for _, n in counts), 0
        for b, n in counts:
            upto += n
            if upto >= need:
                least.append(b / STEPS)
                break
        else:
            least.append(float("-inf"))
    return least


def _scored(docs: DataFrame, labels: DataFrame) -> tuple[Column, DataFrame]:
    """The struct of BASE and SCORES of column ``text``, and the trusted ids."""
    spark = ship(docs.sparkSession)
    trusted = bounded(trusted_ids(labels), MOST_TRUSTED, "trusted")
    raw, target = ngram_counts(docs, trusted)
    return scorer(spark, raw, target)("text"), trusted


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, BASE, base_failed, kept, ratio_1, ratio_2) for each row of ``docs`` (doc_id, text).

    Null texts have no words and fail the base rules. Without trusted documents every ratio is zero and the base rules decide.
    Repeated rows are judged alike; a row with a null doc_id is never trusted. Other columns are not read.
    """
    scores, trusted = _scored(docs, labels)
    rows = materialize(docs.select("doc_id", scores.alias("q")).select("doc_id", "q.*"), "scored")
    least = _thresholds(rows, trusted)
    flagged = rows.join(trusted.withColumn("is_trusted", F.lit(True)), "doc_id", "left")
    own = F.coalesce("is_trusted", F.lit(False))
    ratios = [F.when(own, F.col(f"own_{k}")).otherwise(F.col(f"score_{k}")).alias(f"ratio_{k}") for k in (1, 2)]
    kept = F.when(own, _passes("own", least)).otherwise(_passes("score", least))
    return flagged.select("doc_id", *BASE, _failed().alias("base_failed"), kept.alias("kept"), *ratios)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names.

    Texts are not shuffled for a verdict: most rows pass or fail whether they are trusted or not. Only where that decides is
    the row looked up among the trusted ids.
    """
    (q,) = free_names(docs, "q")
    scores, trusted = _scored(docs, labels)
    rows = materialize(docs.withColumn(q, scores), "scored")
    least = _thresholds(rows.select("doc_id", f"{q}.*"), trusted)
    columns = all_columns(docs)
    field = lambda name: F.col(f"{q}.{name}")
    sound = (field("n_words") >= LEAST_WORDS) & (100 * field("n_repeat_words") <= MOST_REPEATED * field("n_words"))
    other, own = (sound & (field(f"{kind}_1") >= least[0]) & (field(f"{kind}_2") >= least[1]) for kind in ("score", "own"))
    sure = rows.where(other & own).select(*columns)
    open_ = rows.where(other != own).withColumn(q, own)
    as_trusted = open_.where(F.col(q)).join(trusted, "doc_id", "left_semi").select(*columns)
    as_other = open_.where(~F.col(q)).join(trusted, "doc_id", "left_anti").select(*columns)
    return sure.unionByName(as_trusted).unionByName(as_other)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
