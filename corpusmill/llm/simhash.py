"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: of each 3-word shingle (ASCII lower case, repeats included) the XXH64 with seed 42; a bit of the
fingerprint is 1 if it is set in over half of the hashes.

Links: two fingerprints link at ``RADIUS`` = 2 or fewer differing bits. Every bit gets a non-zero code of 3 bits, and
each of the 7 non-zero codes ``v`` makes a mask of the bits whose code has an odd product with ``v``. Two bits span at
most 2 of 3 dimensions, so some ``v`` is orthogonal to both: every pair within the radius agrees under some mask
and meets in that mask's table. No pair can be missed.

Buckets of 2 or 3 different fingerprints are settled from their count, minimum, maximum and XOR. The members of
larger buckets go to the exact way for dense spots: each emits itself and its 64 neighbours at one bit; two
fingerprints within 2 bits share such a point, and a point has at most 65 of them, so no group grows with the data. All
that meet in a point are within 2 bits of each other, so links to the point's smallest are enough for components.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusmill.llm import graph
from corpusmill.llm.graph import connected_components
from corpusmill.llm.text import encoded, word_blocks
from corpusmill.session import ship
from corpusmill.storage import all_columns, discard, free_names, materialize, table

RADIUS, SHINGLE, SEED = 2, 3, 42
MASKS = [sum(1 << i for i in range(64) if bin((1 + i % 7) & v).count("1") % 2) for v in range(1, 8)]
_LANES = np.uint64(0x0101010101010101)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_digests(raw: bytes, size: int = SHINGLE) -> list[bytes]:
    """Big-endian XXH64 digests of all shingles; of the whole sequence if there are fewer words than ``size``."""
    out: list[bytes] = []
    tail: list[bytes] = []
    for words in word_blocks(raw):
        words = tail + words
        out += map(xxhash.xxh64_digest, map(b" ".join, zip(*(words[i:] for i in range(size)))), repeat(SEED))
        tail = words[-(size - 1) :]
    if not out and tail:
        out.append(xxhash.xxh64_digest(b" ".join(tail), SEED))
    return out


def fingerprints(texts, at_once: int = 1 << 18) -> np.ndarray:
    """A fingerprint (uint64) for each text; zero where a text is null or has no words.

    Digests are turned into bits for about ``at_once`` shingles at a time, so memory is bounded by that and one text.
    """
    out = np.zeros(len(texts), dtype=np.uint64)
    digests: list[bytes] = []
    sizes: list[int] = []
    first = 0
    for i, text in enumerate(texts):
        found = shingle_digests(encoded(text).lower())
        sizes.append(len(found))
        digests += found
        if len(digests) >= at_once or i == len(texts) - 1:
            if digests:
                out[first : i + 1] = _majorities(digests, np.array(sizes))
            digests, sizes, first = [], [], i + 1
    return out


def _majorities(digests: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The bits set in over half the digests of each text; each byte lane counts one bit for up to 255 hashes."""
    h = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64)
    out = np.zeros(len(sizes), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    starts = np.cumsum(sizes) - sizes
    pieces = [np.arange(starts[i], starts[i] + sizes[i], 255) for i in some]
    at = np.concatenate(pieces)
    lens = np.array([len(p) for p in pieces])
    begin = np.cumsum(lens) - lens
    for b in range(8):
        lanes = np.add.reduceat((h >> np.uint64(b)) & _LANES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), begin, axis=0)
        ones = (2 * counts > sizes[some][:, None]).astype(np.uint64)
        for j in range(8):
            out[some] |= ones[:, j] << np.uint64(8 * j + b)
    return out


@F.pandas_udf(LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    """The fingerprint of a text column as a signed long."""
    return pd.Series(fingerprints(text.tolist()).view(np.int64))


def _distance(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that connect all fingerprints of ``fps`` (column fp, distinct) within the radius.

    The links have the components of all pairs within the radius, but not every such pair.
    """
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(MASKS)))
    keyed = fps.select("fp", F.inline(tables))
    buckets = materialize(
        keyed.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor("fp").alias("x")).where("n > 1"),
        "buckets",
    )
    mid = F.expr("x ^ a ^ b")
    few = buckets.where("n = 2").select(F.col("a").alias("u"), F.col("b").alias("v"))
    three = buckets.where("n = 3").select(F.inline(F.array(*(F.struct(p.alias("u"), q.alias("v")) for p, q in ((F.col("a"), mid), (mid, F.col("b")), (F.col("a"), F.col("b")))))))
    sparse = few.unionByName(three).where(_distance(F.col("u"), F.col("v")) <= RADIUS)
    crowd = keyed.join(buckets.where("n > 3").select("t", "k"), ["t", "k"], "left_semi").select("fp").distinct()
    points = crowd.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("point"))
    met = points.groupBy("point").agg(F.min("fp").alias("v"), F.collect_set("fp").alias("us")).where("size(us) > 1")  # at most 65
    dense = met.select("v", F.explode("us").alias("u")).where("u != v").select("u", "v")
    out = materialize(sparse.unionByName(dense).distinct(), "links")
    discard(buckets)
    return out


def component_of(rows: DataFrame, member: str, *more: Column) -> DataFrame:
    """For ``rows`` (fp, ``member``): (fp, component), the smallest ``member`` among all fingerprints reachable.

    A null member counts only where there is no other. ``more`` are aggregates of a fingerprint's rows to be carried along.
    """
    fps = materialize(rows.groupBy("fp").agg(F.min(member).alias("least"), *more), "fps")
    carried = [c for c in fps.columns if c not in ("fp", "least")]
    roots = connected_components(links(fps.select("fp"))).withColumnRenamed("id", "fp")
    linked = materialize(roots.join(fps.select("fp", "least"), "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    return materialize(
        fps.join(linked.join(least, "root").select("fp", "component", F.lit(True).alias("is_linked")), "fp", "left")
        .select("fp", F.when(F.col("is_linked"), F.col("component")).otherwise(F.col("least")).alias("component"), *carried),
        "components",
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text).

    Null and wordless texts have fingerprint zero, which links like any other. Rows may repeat. A null doc_id stays
    null and names its component only if all others in it are null too. Other columns are not read.
    """
    ship(docs.sparkSession)
    salt = (F.monotonically_increasing_id() % graph.SALTS).cast("int").alias("salt")
    rows = materialize(docs.select("doc_id", fingerprint("text").alias("fp"), salt), "fingerprints")
    found = component_of(rows, "doc_id", graph.salts_of(F.col("salt")).alias("salts"))
    found = found.select("fp", "component", graph.each_salt(F.col("salts")).alias("salt"))  # copies of one text lie in as many tasks as salts
    return rows.join(found, ["fp", "salt"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays, that with the smallest doc_id.

    Nulls come last, and equal doc_ids are settled by place in the input. All columns stay.
    """
    ship(docs.sparkSession)
    columns = all_columns(docs)
    row, fp = free_names(docs, "row", "fp")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(fp, fingerprint("text")), "fingerprinted")
    slim = rows.select(F.col(fp).alias("fp"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("who"))
    kept = component_of(slim, "who").select(F.col("component.row").alias(row)).distinct()
    return rows.join(kept, row, "left_semi").select(*columns)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
