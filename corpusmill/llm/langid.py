"""Language identification in two steps: first the language's family, then the language within it.

A text's features are the square roots of its hashed byte-trigram frequencies, in lower case and with digits, marks and white
space as one separator. Linear support vector machines, one for each pair of families and one for each pair of languages of a
family, vote; equal votes are settled by margins. They are fitted on a bounded sample of labelled documents.

A winner always wins by half a probability or more, whatever the text, so votes can't tell that a text is in none of the languages.
That is told by how likely its trigrams are in the language that won, against labelled documents kept out of the counting.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from corpusmill.session import ship
from corpusmill.storage import all_columns, free_names, table

BITS = 12
DIMS = 1 << BITS
SAMPLE = 6000  # labelled documents to fit on, shared equally by the languages, and at most SAMPLE_EACH of one
SAMPLE_EACH = 1200
FOLDS, HELD_OUT = 4, 2
LEAST_SCORE = 0.2  # below it the pipeline's stage rejects a document
PARTS = 5  # of the sample; the documents of each are compared with the trigrams of the others
LEAST_LIKE, SLACK = 0.005, 0.5  # quantile of labelled documents, and how much further from the median a text may lie
PRIOR = 0.005  # of each trigram, in documents
UNKNOWN = "und"
PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
FAMILIES = {
    "germanic": "de en nl sv da nb nn no is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la rm",
    "slavic": "ru uk be bg sr hr bs sl sk cs pl mk",
    "uralic": "fi et hu",
    "indic": "hi bn mr ne pa gu ur sa",
    "semitic": "ar he mt am",
    "turkic": "tr az kk uz ky tk",
    "sinitic": "zh yue wuu",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_SEPARATE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_PIECE = 1 << 22


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """A vector of length one for a text; zero if it has under three bytes. In half precision, for fitting and predicting alike."""
    counts = np.zeros(DIMS, dtype=np.int64)
    for start in range(0, len(text), _PIECE):
        piece = f" {text[start : start + _PIECE].lower()} ".encode("utf-8", "surrogatepass").translate(_SEPARATE)
        a = np.frombuffer(piece, dtype=np.uint8).astype(np.uint32)
        code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
        counts += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=DIMS)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float16).astype(np.float32)


def fit_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, epochs: int = 40, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights, the last for a constant, and a scale of margins of a linear SVM on some ``rows`` of x with labels -1 and 1.

    Averaged subgradient steps in a fixed order; x is not copied as a whole.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w = np.zeros(x.shape[1] + 1)
    mean, steps = np.zeros_like(w), 0
    rng = np.random.default_rng(7)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), 64):
            at = order[start : start + 64]
            some = x[rows[at]]
            steps += 1
            wrong = y[at] * (some @ w[:-1] + w[-1]) < 1
            w *= 1 - 1 / (steps + 10)
            if wrong.any():
                pull = weight[at][wrong] * y[at][wrong] / (len(at) * penalty * (steps + 10))
                w[:-1] += pull @ some[wrong]
                w[-1] += pull.sum()
            if epoch >= epochs // 2:
                mean += w
    mean /= max(1, np.linalg.norm(mean))
    margins = np.abs((x @ mean[:-1].astype(x.dtype))[rows] + mean[-1])
    return mean, float(3 / max(1e-9, np.median(margins)))


class Vote:
    """One-versus-one machines between classes; the winner and its probability."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        """``labels`` are those of ``rows`` of x."""
        self.classes = sorted(set(labels))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        fitted = []
        for a, b in self.pairs:
            own = (labels == self.classes[a]) | (labels == self.classes[b])
            fitted.append(fit_svm(x, rows[own], np.where(labels[own] == self.classes[a], 1.0, -1.0)))
        self.weights = np.array([w for w, _ in fitted]).reshape(len(fitted), DIMS + 1)
        self.scales = np.array([s for _, s in fitted])

    def __call__(self, x: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.scales * (self.weights[:, :-1] @ x + self.weights[:, -1])
        votes, sums = np.zeros(len(self.classes)), np.zeros(len(self.classes))
        for (a, b), m in zip(self.pairs, margins):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(range(len(self.classes)), key=lambda k: (votes[k], sums[k], -k))
        against = [m if a == best else -m for (a, b), m in zip(self.pairs, margins) if best in (a, b)]
        return self.classes[best], float(1 / (1 + np.exp(-np.clip(min(against), -50, 50))))


def likeness(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, float]:
    """Log-likelihoods of trigrams in the documents ``own`` (rows of x), and the least mean of them for a text of their language."""
    counts = np.zeros((PARTS, x.shape[1]))
    for i, row in enumerate(own):
        counts[i % PARTS] += x[row].astype(np.float64) ** 2
    logs = lambda c: np.log((c + PRIOR) / (c + PRIOR).sum())
    others = [logs(counts.sum(axis=0) - c) for c in counts]
    means = np.array([others[i % PARTS] @ x[row].astype(np.float64) ** 2 for i, row in enumerate(own)])
    low, middle = np.quantile(means, [LEAST_LIKE, 0.5])
    return logs(counts.sum(axis=0)), float(low - SLACK * (middle - low))


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        family = np.array([FAMILY_OF.get(x.lower().split("-")[0], "other") for x in langs], dtype=object)
        self.families = Vote(x, np.arange(len(x)), family) if len(langs) else None
        self.within = {f: Vote(x, own, langs[own]) for f in set(family) for own in [np.flatnonzero(family == f)]}
        self.likeness = {lang: likeness(x, np.flatnonzero(langs == lang)) for lang in sorted(set(langs))}

    def __call__(self, text: str | None) -> tuple[str, float]:
        if text is None or self.families is None or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, sure = self.families(x)
        lang, also = self.within[family](x)
        logs, least = self.likeness[lang]
        known = logs @ x.astype(np.float64) ** 2 >= least
        return lang, sure * also * (1.0 if known else LEAST_SCORE / 2)


@F.pandas_udf(BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t).astype(np.float16).tobytes() for t in texts])


def fit(labelled: DataFrame, sample: int = SAMPLE, each: int = SAMPLE_EACH) -> Model:
    """A model from ``labelled`` (doc_id, text, lang). It reads at most ``sample`` documents, those with the least hashes of doc_id."""
    ship(labelled.sparkSession)
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    most = max(1, min(each, sample // max(1, len(sizes))))
    place = F.xxhash64(F.lit("langid"), "doc_id")
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.3 * most / n))]) if sizes else F.create_map()
    near = usable.where((F.pmod(place, F.lit(1 << 20)) / float(1 << 20)) < F.coalesce(share[F.col("lang")], F.lit(0.0))) if sizes else usable.limit(0)
    few = Window.partitionBy("lang").orderBy(place, "doc_id", F.xxhash64("text"))
    rows = near.select("lang", _packed("text").alias("x"), F.row_number().over(few).alias("k")).where(F.col("k") <= most).collect()
    rows.sort(key=lambda r: (r["lang"], r["k"]))
    x = np.empty((len(rows), DIMS), dtype=np.float32)
    langs = np.array([r["lang"] for r in rows], dtype=object)
    while rows:  # a row's bytes go as soon as they are read
        last = rows.pop()
        x[len(rows)] = np.frombuffer(last["x"], dtype=np.float16)
    return Model(x, langs)


def predictor(spark: SparkSession, model: Model):
    """A column function: text to a struct (lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value(t) for t in texts], columns=["lang_pred", "score"])

    return predicted


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text, lang).

    Fitted on rows that aren't held out and have a lang. Null texts and those without a letter are ``und`` with score 0, and so is
    everything if no row is labelled. Texts that are less like the language that won than nearly all of its labelled documents score below
    LEAST_SCORE. A null doc_id isn't held out. Repeated rows are predicted alike. Other columns are not read.
    """
    spark = ship(docs.sparkSession)
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return docs.select("doc_id", held_out().alias("held_out"), predictor(spark, model)("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a known language, with all their columns: not ``und``, and a score of LEAST_SCORE or more.

    So texts in a language that no labelled document has, mixed texts and gibberish go.
    """
    spark = ship(docs.sparkSession)
    columns = all_columns(docs)
    (p,) = free_names(docs, "p")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return docs.withColumn(p, predictor(spark, model)("text")).where((F.col(f"{p}.lang_pred") != UNKNOWN) & (F.col(f"{p}.score") >= LEAST_SCORE)).select(*columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
