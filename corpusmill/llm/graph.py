"""Connected components of links in any number, on the executors alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.storage import discard, materialize

SALTS = 64


def salts_of(salt: Column) -> Column:
    """Aggregate: which of the SALTS values occur, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt))


def each_salt(salts: Column) -> Column:
    """A row for each value in the bits of :func:`salts_of`: one for a key of one row, SALTS for a very frequent key."""
    return F.explode(F.filter(F.array(*map(F.lit, range(SALTS))), lambda i: F.getbit(salts, i) == 1))


def _salted(links: DataFrame) -> DataFrame:
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))


def _least(links: DataFrame) -> DataFrame:
    """(u, m, salts) of salted links: the smallest neighbour of a node, and which salts its links have."""
    return links.groupBy("u").agg(F.min("v").alias("m"), salts_of(F.col("salt")).alias("salts"))


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Salted ``links`` with the ``m`` of ``least``. A node with very many links is dealt to SALTS tasks, and ``least`` has no more rows than there are links."""
    return links.join(least.select("u", "m", each_salt(F.col("salts")).alias("salt")), ["u", "salt"]).select("u", "v", "m")


def _large_star(links: DataFrame) -> DataFrame:
    both = _salted(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = _least(both).withColumn("m", F.least("u", "m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    links = _salted(links)
    least = _least(links)
    return _with_least(links, least).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, root) for each id in ``links`` (u, v); root is the smallest id reachable.

    Alternating large and small stars: each round links nodes to the smallest neighbour known, until every component is
    one star. The links of a round go to the shared folder, and only their count and a checksum to the driver.
    """
    now = materialize(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not state[0] or state == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        seen = state
        after = materialize(_small_star(_large_star(now)), "star")
        discard(now)
        now = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
