"""Packing documents into training sequences by Karmarkar-Karp multiway differencing.

A document's token ids are cut into whole sequences as long as it fills them; what remains is balanced with the remainders of
other documents into windows of nearly equal sums. Differencing starts from one partial partition for each remainder and
always merges the two with the widest spread, the largest sum of one with the smallest of the other. If a window
exceeds the capacity, the number of windows rises by one. Where remainders are too coarse for little padding, the
larger ones are halved and balanced anew.

Each task packs what it reads, in groups of a fixed size: nothing is shuffled, memory doesn't depend on the data, and a
task that is run again gives the same sequences.
"""

from __future__ import annotations

import heapq
import struct
from bisect import insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.text import encoded, word_blocks
from corpusmill.session import ship
from corpusmill.storage import table

CAPACITY, END_ID = 2048, 1
GROUP = 1024  # remainders balanced together: at most 8 MB of ids
FULL_ENOUGH = 0.99  # a group's share of tokens in its windows from which no more pieces are halved
LEAST_PIECE = 128
CACHED_WORDS = 1_000_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


_MARKS = (b".", b",", b";", b":", b"!", b"?")
PROBES = ["The  Quick brown\tfox,", "naïve Café? ÉCOLE Straße; İstanbul", "a\nb  c\r\nd", "x1 2024-01-02 3.14! don't (yes) e.g.: §5", " lead and trail ", "日本語 テキスト 한글", "ab" * 40]


class WordTokenizer:
    """Token ids of whole texts, as little-endian 32-bit bytes, by a tokenizer whose tokens never span ASCII white space.

    Ids are looked up word by word, so each word is tokenized about once for each worker. A text with ``<|`` may hold
    strings that stand for special tokens and goes to the tokenizer as a whole. So does every text if ``PROBES`` show that the tokenizer
    isn't of that kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.by_word = True
        self.by_word = list(self.ids(PROBES)) == [self._encode([t])[0] for t in PROBES]

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words that are letters alone: each is one token with an end of its own, so many go through as one text."""
        out = []
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            raw, begin = self._encode([" ".join(some)])[0], 0
            flat = np.frombuffer(raw, dtype="<u4")
            ends = np.flatnonzero(self.closes[flat]) + 1
            if len(ends) != len(some):
                out += self._encode(some)
                continue
            for end in (4 * ends).tolist():
                out.append(raw[begin:end])
                begin = end
        return out

    def _learn(self, words: set[bytes]) -> None:
        """Case and closing marks need no tokenizer: it lower-cases ASCII, and tells letters and marks apart."""
        known, new = self.known, list(words)
        plain: dict[bytes, None] = {}
        other: list[bytes] = []
        later: list[tuple[bytes, bytes, bytes]] = []
        for w, s in zip(new, b" ".join(new).decode("utf-8", "surrogatepass").split(" ")):
            mark = b""
            if not s.isalpha():
                mark = w[-1:]
                if mark not in _MARKS or not s[:-1].isalpha():
                    other.append(w)
                    continue
            stem = w[:-1] if mark else w
            if s.isascii():
                stem = stem.lower()
            if stem not in known:
                plain[stem] = None
            if stem is not w:
                later.append((w, stem, mark))
        for kind, encode in ((list(plain), self._encode_letters), ([*other, *_MARKS], self._encode)):
            known.update(zip(kind, encode(b" ".join(kind).decode("utf-8", "surrogatepass").split(" ")) if kind else ()))
        for w, stem, mark in later:
            known[w] = known[stem] + known[mark] if mark else known[stem]

    def ids(self, texts: Iterable[str | None], at_once: int = 1 << 21) -> Iterator[bytes]:
        """Ids of each text in order. Words are learnt for about ``at_once`` bytes of texts together."""
        lists: list[list[list[bytes]] | str] = []
        size = 0
        for text in texts:
            raw = encoded(text)
            lists.append(list(word_blocks(raw)) if self.by_word and b"<|" not in raw else text or "")
            size += len(raw)
            if size > at_once:
                yield from self._looked_up(lists)
                lists, size = [], 0
        yield from self._looked_up(lists)

    def _looked_up(self, lists: list) -> Iterator[bytes]:
        words = set().union(*(block for blocks in lists if not isinstance(blocks, str) for block in blocks))
        if new := words.difference(self.known):
            if len(self.known) + len(new) > CACHED_WORDS:
                self.known.clear()
                new = words
            self._learn(new)
        for blocks in lists:
            if isinstance(blocks, str):
                yield self._encode([blocks])[0]
            else:
                yield b"".join([b"".join(map(self.known.__getitem__, block)) for block in blocks])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``ways`` parts with nearly equal sums.

    A partial partition holds its non-zero sums, smallest first; the rest of its ``ways`` sums are zero.
    """
    heap = [(-s, i, [(s, i, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(b) > len(a):
            a, b = b, a
        over = len(a) + len(b) - ways
        if over <= 0:
            merged = a
            for x in b:
                insort(merged, x)
        else:  # the smallest sums of one meet the smallest of the other's that are left over from its zeros
            met = [(x[0] + y[0], tick + 1 + k, (x[2], y[2])) for k, (x, y) in enumerate(zip(a[:over], b[:over][::-1]))]
            tick += over + 1
            if over == 1 and len(b) == 1:
                merged = a[1:]
                insort(merged, met[0])
            else:
                merged = sorted(a[over:] + b[over:] + met)
        tick += 1
        spread = merged[-1][0] - (merged[0][0] if len(merged) == ways else 0)
        heapq.heappush(heap, (-spread, tick, merged))
    parts = []
    for _, _, tree in heap[0][2] if heap else []:
        found, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                found.append(x)
        parts.append(sorted(found))
    return parts


def windows(sizes: list[int], capacity: int = CAPACITY, most: int | None = None) -> list[list[int]] | None:
    """Parts of ``sizes`` with sums of at most ``capacity``; none if that takes over ``most`` parts.

    The number of parts rises while a part exceeds the capacity, by as many as the excess fills.
    """
    ways = max(1, -(-sum(sizes) // capacity))
    while most is None or ways <= most:
        parts = differencing(sizes, ways)
        excess = sum(max(0, sum(sizes[i] for i in p) - capacity) for p in parts)
        if not excess:
            return parts
        ways += max(1, excess // capacity)
    return None


def balanced(pieces: list[tuple[int, int]], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length) for the ``pieces`` (start, length), one for each document of a group."""
    total, longest = sum(n for _, n in pieces), capacity
    enough = max(-(-total // capacity), int(total / (FULL_ENOUGH * capacity)))
    cut = [(d, s, n) for d, (s, n) in enumerate(pieces)]
    while True:
        parts = windows([n for _, _, n in cut], capacity, enough if longest // 2 >= LEAST_PIECE else None)
        if parts is not None:
            return [[cut[i] for i in p] for p in parts]
        longest //= 2
        cut = [(d, s + k, min(longest, n - k)) for d, s, n in cut for k in range(0, n, longest)]


def packed(docs: Iterable[tuple[int | None, bytes]], first_sequence: int, capacity: int = CAPACITY) -> Iterator[tuple]:
    """Rows of SCHEMA for documents (doc_id, ids as bytes)."""
    sequence = first_sequence
    waiting: list[tuple[int | None, int, bytes, int]] = []

    def flush() -> Iterator[tuple]:
        nonlocal sequence
        for window in balanced([(s, len(b) // 4) for _, s, b, _ in waiting], capacity):
            offset = 0
            for d, start, n in window:
                doc_id, first, ids, total = waiting[d]
                at = 4 * (start - first)
                yield doc_id, start, n, ids[at : at + 4 * n], total, sequence, offset
                offset += n
            sequence += 1
        waiting.clear()

    for doc_id, ids in docs:
        total = len(ids) // 4
        whole = total - total % capacity
        for start in range(0, whole, capacity):
            yield doc_id, start, capacity, ids[4 * start : 4 * (start + capacity)], total, sequence, 0
            sequence += 1
        if whole < total:
            waiting.append((doc_id, whole, ids[4 * whole :], total))
        if len(waiting) >= GROUP:
            yield from flush()
    if waiting:
        yield from flush()


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row (SCHEMA) for each piece of ``docs`` (doc_id, text); ``ids`` are little-endian unsigned 32-bit.

    A null text is empty: its document is the end id alone. Repeated rows are packed as often as they stand there, and a
    null doc_id stays null. Other columns are not read.
    """
    ship(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        documents = ((d, ids + end) for b in batches for d, ids in zip(b.column(0).to_pylist(), words.ids(b.column(1).to_pylist())))
        rows: list[tuple] = []
        size = 0
        for row in packed(documents, TaskContext.get().partitionId() << 40, capacity):
            rows.append(row)
            size += len(row[3])
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), default_tokenizer()))
