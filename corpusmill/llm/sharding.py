"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over a table of prime size, and the shards take turns claiming their next
free slot until the table is full. A row's key hashes to a slot, and the slot names its shard: constant time, equal
shares, and few rows move when a shard goes or comes. The table's size is fixed by ``SLOTS``, whatever the data, so
it can be broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.storage import all_columns, free_names, table

SHARDS, SLOTS = 32, 4099  # SLOTS is prime and over 100 times SHARDS
MOST_SLOTS = 1 << 20  # of a table that may be broadcast: under 16 MB


def slot_hash(key: Column, salt: str = "") -> Column:
    """60 bits of MD5, which other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 15), 16, 10).cast("long")


def preferences(spark: SparkSession, names: list[str], slots: int) -> list[tuple[int, int]]:
    """Offset and stride of each shard's walk over the table."""
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = rows.select("i", (slot_hash(F.col("name"), "offset:") % slots).alias("o"), (slot_hash(F.col("name"), "stride:") % (slots - 1) + 1).alias("s")).orderBy("i").collect()
    return [(r.o, r.s) for r in got]


def fill(walks: list[tuple[int, int]], slots: int) -> list[int]:
    """The shard of each slot. Every walk visits every slot, as its stride and the prime have no common factor."""
    owner, steps = [-1] * slots, [0] * len(walks)
    left = slots
    while left:
        for i, (offset, stride) in enumerate(walks):
            while owner[at := (offset + steps[i] * stride) % slots] >= 0:
                steps[i] += 1
            owner[at] = i
            left -= 1
            if not left:
                break
    return owner


def lookup_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) for the shards in ``names``."""
    if not names or slots <= len(names) or slots > MOST_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table's size must be prime, over the number of shards and at most MOST_SLOTS")
    return spark.createDataFrame(list(enumerate(fill(preferences(spark, names, slots), slots))), "slot long, shard int")


def place(rows: DataFrame, key: str, names: list[str], slots: int = SLOTS, into: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """``rows`` with two more columns: the slot of ``key`` and its shard.

    Equal keys go together; a null key hashes like the empty string. Columns of ``rows`` named as ``into`` are replaced.
    No row moves: the only exchange is the broadcast of the table.
    """
    spark = rows.sparkSession
    keep = [c for c, name in zip(all_columns(rows), rows.columns) if name not in into]
    slot, shard = free_names(rows, "slot", "shard")
    slotted = rows.select(*keep, (slot_hash(F.coalesce(F.col(key).cast("string"), F.lit("")), "key:") % slots).alias(slot))
    owners = lookup_table(spark, names, slots).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    return slotted.join(F.broadcast(owners), slot).select(*keep, F.col(slot).alias(into[0]), F.col(shard).alias(into[1]))


def write_sharded(rows: DataFrame, path: str, key: str, names: list[str], slots: int = SLOTS) -> None:
    """``rows`` as Parquet with a folder for each shard. Tasks write their own part of each shard: no shuffle, no hot task."""
    place(rows, key, names, slots).write.partitionBy("shard").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard, with the size of its text in characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return place(docs, "doc_id", shard_names())


def stated_owners(names: list[str], slots: int) -> list[int]:
    """The table by its definition, hashed without Spark: what the SQL below and the tests hold the operator against."""
    h = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    walks = [iter([(h(f"offset:{n}") + k * (h(f"stride:{n}") % (slots - 1) + 1)) % slots for k in range(slots)]) for n in names]
    owners: dict[int, int] = {}
    turn = 0
    while len(owners) < slots:
        owners[next(s for s in walks[turn % len(names)] if s not in owners)] = turn % len(names)
        turn += 1
    return [owners[s] for s in range(slots)]


def op2_sql() -> str:
    return f"""
WITH owners AS (SELECT unnest(range({SLOTS})) AS slot, unnest({stated_owners(shard_names(), SLOTS)})::INTEGER AS shard)
SELECT doc_id, n_chars, slot, shard FROM (
  SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars,
    ('0x' || substr(md5('key:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents) JOIN owners USING (slot)
"""
