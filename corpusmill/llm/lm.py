"""Scores by a bigram language model with deleted interpolation.

Tokens are the words of a text in ASCII lower case, then one end. The model's probability of a token ``w`` after ``u`` mixes
the maximum-likelihood estimates c(u, w) / c(u) and c(w) / N and a uniform share 1 / (V + 1); the weights of the mix
depend on the bucket (powers of two) of the context's frequency c(u). They are learned by expectation-maximisation
on held-out counts: the training documents fall into two parts, each is deleted in turn, and its tokens are predicted
from the counts of the other. EM runs on a histogram of the estimates' ratios, whose size is fixed.

Counts are exact over all training documents and are never gathered in one place. Documents are cut into blocks of about
``BLOCK_TOKENS`` tokens. A block sends its distinct words and bigrams with their counts to buckets of the key space, as
arrays; a bucket adds them up and answers every block with totals in the order of the question. Words are counted by their
bytes, bigrams by hashes with ``SPARE_BITS`` bits more than the number of tokens needs, and 64 at most, so that about one
bigram in a million shares its hash.

No bucket hears more than about ``FAN`` senders. Beyond ``FAN`` blocks the counts meet in levels: groups of ``FAN`` blocks
add theirs up in ranges of the key space, each range of a group is a sender to the finer buckets in it, and totals come back
the same way. So a block sends at most ``FAN`` rows whatever the size of the corpus, and the most frequent word is at most
``FAN`` entries in one bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.text import encoded, word_blocks
from corpusmill.session import ship
from corpusmill.storage import discard, materialize, table

FOLDS, HELD_OUT = 7, 2
BLOCK_TOKENS = 1 << 20
BUCKET_TOKENS = 1 << 21  # training and test tokens for each bucket of the key space
SPARE_BITS = 20
FAN = 1 << 14  # senders that one bucket hears, and buckets that one sender sends to
TASK_BUCKETS = 8  # buckets, or blocks, for each shuffle partition at most
STEPS, REACH = 4, 200  # of the histogram: steps in an octave, and the most steps to either side
MOST_CONTEXT = 24  # contexts seen 2**24 times or more share a bucket
EM_ROUNDS = 100
LEAST_WEIGHT = 1e-6
END = b""  # no word is empty
_START = np.uint64(0x8F14E45FCEEA167A)
_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KINDS = ["u1", "<u2", "<u4", "<u8"]

BLOCK = "block long, tokens long, doc_ids array<long>, parts binary, lengths binary, words binary, ids binary"
SENT = "bucket long, block long, words binary, word_counts binary, keys binary, key_counts binary"
ANSWER = "bucket long, block long, word_counts binary, key_counts binary, train_words long"
KEY_COLUMNS = ["words", "word_counts", "keys", "key_counts"]
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(a: np.ndarray) -> bytes:
    """Non-negative integers in the smallest type that holds them all, compressed, with the type in front."""
    kind = next(k for k, t in enumerate(_KINDS) if not len(a) or int(a.max()) <= np.iinfo(t).max)
    return bytes([kind]) + zstandard.compress(a.astype(_KINDS[kind]).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw[1:]), dtype=_KINDS[raw[0]]).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[dict]:
    """Rows of BLOCK from batches (doc_id, text, part)."""
    known: dict[bytes, int] = {END: 0}
    docs: list[tuple] = []
    ids: list[np.ndarray] = []
    size, number = 0, count(first)

    def block() -> dict:
        return {
            "block": next(number),
            "tokens": size,
            "doc_ids": [d for d, _, _ in docs],
            "parts": bytes(p for _, p, _ in docs),
            "lengths": packed(np.array([n for _, _, n in docs], dtype=np.int64)),
            "words": zstandard.compress(b"\n".join(known), 1),
            "ids": packed(np.concatenate(ids)),
        }

    for b in batches:
        for doc_id, text, part in zip(*(c.to_pylist() for c in b.columns)):
            n = 1
            for words in word_blocks(encoded(text).lower()):
                new = [w for w in dict.fromkeys(words) if w not in known]
                known.update(zip(new, range(len(known), len(known) + len(new))))
                ids.append(np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)))
                n += len(words)
            ids.append(np.zeros(1, dtype=np.int32))
            docs.append((doc_id, part, n))
            size += n
            if size >= BLOCK_TOKENS:
                yield block()
                known, docs, ids, size = {END: 0}, [], [], 0
    if docs:
        yield block()


def cuts(word_keys: np.ndarray, keys: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, slice, slice, np.ndarray]]:
    """For each bucket with some of these sorted words or bigrams: its number, which they are, and the bigrams' keys from its begin."""
    w, k = (((x >> np.uint64(n - 32)) * np.uint64(buckets)) >> np.uint64(32) for x, n in ((word_keys, 64), (keys, bits)))
    some = np.union1d(w, k)
    ends = [np.searchsorted(x, some, side).tolist() for x in (w, k) for side in ("left", "right")]
    for i, w0, w1, k0, k1 in zip(some.tolist(), *ends):
        yield i, slice(w0, w1), slice(k0, k1), keys[k0:k1] - _begin(i, buckets, bits)


def _begin(bucket: int, buckets: int, bits: int) -> np.uint64:
    return np.uint64(((bucket << 32) // buckets) << (bits - 32))


def _row(words: list[bytes], word_counts: np.ndarray, keys: np.ndarray, key_counts: np.ndarray) -> tuple:
    """The last four columns of SENT. Counts have a row for each part."""
    return zstandard.compress(b"\n".join([b"", *words]), 1), packed(word_counts.ravel()), packed(np.diff(keys, prepend=np.uint64(0))), packed(key_counts.ravel())


class Block:
    """A block's tokens, words and bigrams. Words and bigrams are in the order of their keys."""

    def __init__(self, parts: bytes, lengths: bytes, words: bytes, ids: bytes, bits: int):
        self.words = zstandard.decompress(words).split(b"\n")
        self.parts = np.frombuffer(parts, dtype=np.uint8)
        self.lengths = unpacked(lengths)
        self.ids = unpacked(ids)
        n = len(self.words)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), dtype=np.uint64, count=n)
        self.word_order = np.argsort(hashes, kind="stable")
        self.word_keys = hashes[self.word_order]
        ends = np.cumsum(self.lengths)
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[ends - self.lengths] = n
        pairs, self.bigrams = np.unique(before * n + self.ids, return_inverse=True)
        first, second = pairs // n, pairs % n
        left = np.append(hashes, _START)[first]
        keys = ((left * _ODD) ^ ((left * _ODD) >> np.uint64(31))) + hashes[second] * _MORE
        keys = ((keys ^ (keys >> np.uint64(29))) * _ODD) >> np.uint64(64 - bits)
        self.key_order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.second = keys[self.key_order], first, second
        self.bits = bits
        self.part_of_token = np.repeat(self.parts, self.lengths)

    def counts(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Of words and bigrams in one part, in the order of keys."""
        own = self.part_of_token == part
        return np.bincount(self.ids[own], minlength=len(self.words))[self.word_order], np.bincount(self.bigrams[own], minlength=len(self.keys))[self.key_order]

    def cuts(self, buckets: int) -> Iterator[tuple[int, slice, slice, np.ndarray]]:
        return cuts(self.word_keys, self.keys, self.bits, buckets)

    def totals(self, answers: Iterable[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Totals (part, word) and (part, bigram) in local order, from the buckets' answers in order."""
        out = []
        for order, raw in zip((self.word_order, self.key_order), zip(*answers)):
            both = np.concatenate([unpacked(x).reshape(2, -1) for x in raw], axis=1)
            local = np.empty_like(both)
            local[:, order] = both
            out.append(local)
        return tuple(out)


def _sent(blocks: pd.DataFrame, buckets: int, bits: int) -> Iterator[tuple]:
    """Rows of SENT: what each block sends to the buckets in which it has words or bigrams."""
    for row in blocks.itertuples(index=False):
        b = Block(row.parts, row.lengths, row.words, row.ids, bits)
        word_counts, key_counts = (np.stack(x) for x in zip(b.counts(1), b.counts(2)))
        words = [b.words[i] for i in b.word_order]
        for i, w, k, keys in b.cuts(buckets):
            yield i, row.block, *_row(words[w], word_counts[:, w], keys, key_counts[:, k])


class Bucket:
    """What some senders sent to one bucket, added up. Words are in the order of their hashes, bigrams in that of their keys."""

    def __init__(self, rows: pd.DataFrame):
        index: dict[bytes, int] = {}
        words = [np.fromiter((index.setdefault(w, len(index)) for w in zstandard.decompress(x).split(b"\n")[1:]), dtype=np.int64) for x in rows["words"]]
        names = sorted(index)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), dtype=np.uint64, count=len(names))
        order = np.argsort(hashes, kind="stable")
        self.word_keys, self.words = hashes[order], [names[i] for i in order]
        place = np.empty(len(names), dtype=np.int64)
        place[[index[w] for w in self.words]] = np.arange(len(names))
        keys = [np.cumsum(unpacked(x)) for x in rows["keys"]]
        self.keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        self.word_at = [place[x] for x in words]
        self.key_at = np.split(at, np.cumsum([len(x) for x in keys])[:-1])
        self.word_sums = self._added(rows["word_counts"], np.concatenate(self.word_at), len(names))
        self.key_sums = self._added(rows["key_counts"], at, len(self.keys))

    @staticmethod
    def _added(raw: Iterable[bytes], at: np.ndarray, size: int) -> np.ndarray:
        each = np.concatenate([unpacked(x).reshape(2, -1) for x in raw], axis=1)
        return np.stack([np.bincount(at, weights=n, minlength=size).astype(np.int64) for n in each])

    def answers(self, rows: pd.DataFrame, words: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
        """Rows of ANSWER to the senders of ``rows`` from totals (part, word) and (part, bigram)."""
        out = rows[["bucket", "block"]].reset_index(drop=True)
        out["word_counts"] = [packed(words[:, x].ravel()) for x in self.word_at]
        out["key_counts"] = [packed(keys[:, x].ravel()) for x in self.key_at]
        return out.assign(train_words=0)


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals over all senders for one bucket, and how many of its words are in training."""
    b = Bucket(rows)
    out = b.answers(rows, b.word_sums, b.key_sums)
    out.loc[0, "train_words"] = int((b.word_sums.sum(axis=0) > 0).sum())
    return out


def _merged(rows: pd.DataFrame, buckets: int, share: int, bits: int) -> pd.DataFrame:
    """Rows of SENT from a group of senders, added up, to the ``share`` finer buckets in one of ``buckets``."""
    b, found = Bucket(rows), []
    keys = b.keys.astype(np.uint64) + _begin(int(rows["bucket"].iloc[0]), buckets, bits)
    for i, w, k, own in cuts(b.word_keys, keys, bits, buckets * share):
        found.append((i, rows["group"].iloc[0], *_row(b.words[w], b.word_sums[:, w], own, b.key_sums[:, k])))
    return pd.DataFrame(found, columns=["bucket", "block", *KEY_COLUMNS])


def _shared(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
    """Rows of ANSWER to the senders of a group from the totals that the group was told by the finer buckets."""
    b, totals = Bucket(rows), totals.sort_values("bucket")
    return b.answers(rows, *(np.concatenate([unpacked(x).reshape(2, -1) for x in totals[c]], axis=1) for c in ("word_counts", "key_counts")))


def _dealt(df: DataFrame, units: int, *by: str) -> DataFrame:
    """``df`` by columns in as many partitions as ``units`` need, where Spark's setting has fewer."""
    need = -(-units // TASK_BUCKETS)
    return df.repartition(need, *by) if need > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _gathered(sent: DataFrame, senders: int, buckets: int, bits: int) -> tuple[DataFrame, int]:
    """ANSWER for all rows of SENT, written, and the number of distinct words in training.

    A bucket hears at most ``senders`` senders.
    """
    if senders <= FAN:
        answers = materialize(_dealt(sent, buckets, "bucket").groupBy("bucket").applyInPandas(_answer, ANSWER), "answers")
        return answers, answers.agg(F.sum("train_words")).first()[0] or 0
    groups = -(-senders // FAN)
    share = min(FAN, groups)
    wide = sent.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    wide = _dealt(wide, buckets * groups, "bucket", "group").groupBy("bucket", "group")
    units = materialize(wide.applyInPandas(lambda rows: _merged(rows, buckets, share, bits), SENT), "units")
    told, distinct = _gathered(units, groups, buckets * share, bits)
    back = told.withColumn("coarse", F.floor(F.col("bucket") / share).cast("long"))
    back = _dealt(back, buckets * groups, "coarse", "block").groupBy("coarse", "block")
    answers = materialize(wide.cogroup(back).applyInPandas(_shared, ANSWER), "answers")
    discard(units, told)
    return answers, distinct


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, and one more for each power of two."""
    return np.minimum(MOST_CONTEXT, np.ceil(np.log2(counts + 1.0))).astype(np.int64)


def estimates(words: np.ndarray, pairs: np.ndarray, first: np.ndarray, second: np.ndarray, starts: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bigram its context's count and the maximum-likelihood estimates of first and second order."""
    context = np.append(words, starts)[first]
    return context, words[second] / max(1, total), pairs / np.maximum(1, context)


def _step(ratio: np.ndarray) -> np.ndarray:
    """Ratios to the uniform share as steps of the histogram; below all others if zero."""
    with np.errstate(divide="ignore"):
        return np.maximum(-REACH, np.minimum(REACH, np.rint(STEPS * np.log2(ratio)))).astype(np.int64)


def _histogram(blocks: pd.DataFrame, sums: dict) -> Iterator[tuple]:
    """(context bucket, steps of both orders, tokens): each part's tokens under the other part's counts."""
    uniform = 1 / (sums["distinct"] + 1)
    found: Counter = Counter()
    for row in blocks.itertuples(index=False):
        b = Block(row.parts, row.lengths, row.words, row.ids, sums["bits"])
        words, pairs = b.totals(row.answers)
        for own, other in ((1, 1), (2, 0)):  # the tokens of part 1 under the counts of part 2, and the other way round
            n = np.bincount(b.bigrams[b.part_of_token == own], minlength=len(b.first))
            at = np.flatnonzero(n)
            context, p1, p2 = estimates(words[other], pairs[other][at], b.first[at], b.second[at], sums["starts"][other], sums["tokens"][other])
            code = (context_bucket(context) * (2 * REACH + 1) + _step(p1 / uniform) + REACH) * (2 * REACH + 1) + _step(p2 / uniform) + REACH
            kinds, which = np.unique(code, return_inverse=True)
            found.update(dict(zip(kinds.tolist(), np.bincount(which, weights=n[at]).astype(np.int64).tolist())))
    yield from found.items()


def learn_weights(histogram: dict[int, int]) -> np.ndarray:
    """Weights (context bucket, order 0 to 2) by expectation-maximisation. A bucket without tokens takes those of the one below."""
    out = np.zeros((MOST_CONTEXT + 1, 3))
    out[:, 0] = 1
    codes, tokens = np.array(sorted(histogram), dtype=np.int64), np.array([histogram[k] for k in sorted(histogram)], dtype=np.float64)
    bucket, steps = codes // (2 * REACH + 1) ** 2, codes % (2 * REACH + 1) ** 2
    one, two = steps // (2 * REACH + 1) - REACH, steps % (2 * REACH + 1) - REACH
    p = np.stack([np.ones(len(codes)), *(np.where(s > -REACH, np.exp2(s / STEPS), 0.0) for s in (one, two))], axis=1)
    for k in range(MOST_CONTEXT + 1):
        own = bucket == k
        if not own.any():
            out[k] = out[k - 1] if k else out[k]
            continue
        w = np.full(3, 1 / 3)
        for _ in range(EM_ROUNDS):
            share = p[own] * w
            share /= share.sum(axis=1, keepdims=True)
            w = np.maximum(LEAST_WEIGHT, tokens[own] @ share / tokens[own].sum())
            w /= w.sum()
        out[k] = w
    return out


def _scores(blocks: pd.DataFrame, sums: dict, weights: np.ndarray) -> pd.DataFrame:
    total, distinct = sum(sums["tokens"]), sums["distinct"]
    frames = []
    for row in blocks.itertuples(index=False):
        b = Block(row.parts, row.lengths, row.words, row.ids, sums["bits"])
        words, pairs = (x.sum(axis=0) for x in b.totals(row.answers))
        context, p1, p2 = estimates(words, pairs, b.first, b.second, sum(sums["starts"]), total)
        w = weights[context_bucket(context)]
        logs = np.log10(w[:, 0] / (distinct + 1) + w[:, 1] * p1 + w[:, 2] * p2)
        base = np.log10((words + 1) / (total + distinct + 1))
        begin = np.cumsum(b.lengths) - b.lengths
        frames.append(
            pd.DataFrame(
                {
                    "doc_id": pd.array([None if pd.isna(d) else int(d) for d in row.doc_ids], dtype="Int64"),
                    "held_out": b.parts == 0,
                    "n_tokens": b.lengths,
                    "n_known": np.add.reduceat((words > 0)[b.ids].astype(np.int64), begin),
                    "train_tokens": total,
                    "base_score": np.add.reduceat(base[b.ids], begin),
                    "score": np.add.reduceat(logs[b.bigrams], begin),
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


def _frames(make, names: list[str]):
    """A function for mapInPandas: one block of an input frame after another through ``make``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(len(f)):
                rows = make(f.iloc[i : i + 1])
                out = rows if isinstance(rows, pd.DataFrame) else pd.DataFrame(rows, columns=names)
                if len(out):
                    yield out

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text).

    Learns from the rows that aren't held out: crc32(doc_id as text) mod 7 is not 2. A null text is one end; a null doc_id
    learns and stays null; repeated rows count and are scored as often as they stand there. If nothing is learned from,
    every token has probability 1 / (V + 1) = 1. ``base_score`` is the add-one unigram score. Other columns are not read.
    """
    from pyspark import TaskContext

    ship(docs.sparkSession)
    crc = F.crc32(F.col("doc_id").cast("string"))
    part = F.when(crc % FOLDS == HELD_OUT, 0).otherwise(1 + F.coalesce(F.floor(crc / FOLDS) % 2, F.lit(0))).cast("int")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        for row in _blocks(batches, TaskContext.get().partitionId() << 32):
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row.values(), kinds)], list(row))

    blocks = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), part.alias("part")).mapInArrow(cut, BLOCK), "blocks")
    everything, n_blocks = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    bits = min(64, max(32, SPARE_BITS + everything.bit_length()))
    buckets = max(1, -(-min(everything, FAN * BLOCK_TOKENS) // BUCKET_TOKENS))
    sent = blocks.select("block", "parts", "lengths", "words", "ids").mapInPandas(_frames(lambda f: _sent(f, buckets, bits), [x.split()[0] for x in SENT.split(", ")]), SENT)
    answers, distinct = _gathered(sent, n_blocks, buckets, bits)
    parts = blocks.select("parts", "lengths").mapInPandas(_frames(_part_sums, ["part", "tokens", "docs"]), "part int, tokens long, docs long").groupBy("part").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).collect()
    size = {r["part"]: (r["tokens"], r["docs"]) for r in parts}
    sums = {"bits": bits, "distinct": distinct, "tokens": [size.get(p, (0, 0))[0] for p in (1, 2)], "starts": [size.get(p, (0, 0))[1] for p in (1, 2)]}
    of_block = _dealt(answers, n_blocks, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "word_counts", "key_counts"))).alias("a"))
    joined = _dealt(blocks.drop("tokens"), n_blocks, "block").join(of_block, "block").withColumn("answers", F.transform("a", lambda x: F.struct(x["word_counts"], x["key_counts"]))).drop("a")
    answered = materialize(joined, "answered")
    discard(blocks, answers)
    histogram = answered.drop("doc_ids").mapInPandas(_frames(lambda f: _histogram(_tuples(f), sums), ["code", "tokens"]), "code long, tokens long")
    cells = histogram.groupBy("code").agg(F.sum("tokens").alias("tokens")).collect()  # at most (MOST_CONTEXT + 1) * (2 * REACH + 1) ** 2, and some thousands in practice
    weights = learn_weights({r["code"]: r["tokens"] for r in cells})
    return answered.mapInPandas(_frames(lambda f: _scores(_tuples(f), sums, weights), []), SCORE)


def _part_sums(blocks: pd.DataFrame) -> Iterator[tuple]:
    for row in blocks.itertuples(index=False):
        parts, lengths = np.frombuffer(row.parts, dtype=np.uint8), unpacked(row.lengths)
        for p in (0, 1, 2):
            yield p, int(lengths[parts == p].sum()), int((parts == p).sum())


def _tuples(blocks: pd.DataFrame) -> pd.DataFrame:
    """Answers as pairs of bytes."""
    return blocks.assign(answers=[[(bytes(x["word_counts"]), bytes(x["key_counts"])) for x in a] for a in blocks["answers"]])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
