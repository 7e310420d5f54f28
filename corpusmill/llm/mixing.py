"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has the key ``u ** (1 / weight)``: ``u`` is uniform from a hash of its id, and the weight is its quality. Within
a source the largest keys come first. A source's target first pays for complete epochs over all its documents; what is
left is a budget in words, and the documents are taken in the order of their keys until their prefix sum fills it.

No source is sorted as a whole. Keys fall into ``BINS`` bins on a scale on which they spread alike for every weight; sums over
(source, bin) are combined before they are shuffled, and their prefix sums say which bin holds the end of the budget. That bin is
cut into ``BINS`` finer ones in the same way. What lies before the end is taken, what lies after it is not, and only the
documents of one fine bin are sorted: less than one in a million of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.sharding import slot_hash
from corpusmill.storage import all_columns, free_names, materialize, numbered, table

BINS = 1 << 12
LEAST_LOG, MOST_LOG = -22.0, 8.0  # of the logarithms of exponentials that the bins tell apart
MOST_EPOCHS = 3
LEAST_WEIGHT = 0.05
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>!]"


def size_of(text: Column) -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(size: Column, text: Column) -> Column:
    """The share of words among words and symbols, at least LEAST_WEIGHT."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0))
    return F.greatest(F.lit(LEAST_WEIGHT), size / F.greatest(size + symbols, F.lit(1)))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    u = (slot_hash(F.coalesce(doc_id.cast("string"), F.lit("")), "mix:").cast("double") + 0.5) / float(1 << 60)
    return F.pow(u, 1 / weight)


def targets(sizes: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from ``sizes`` (source, source_size), one row for each source.

    Sources by code point, null last, weigh 1, 2, 3 and again. They share the sum of all sizes by weight; a target stops at
    ``most`` times its source, and the excess goes to the others by weight until none is above. Only sums reach the driver.
    """
    ranked = numbered(sizes, F.col("source").asc_nulls_last(), "w")
    weighed = materialize(ranked.withColumn("w", (F.col("w") - 1) % 3 + 1).withColumn("cap", most * F.col("source_size")), "sources")
    everything = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("cap") <= level * F.col("w")
        paid, n, open_weight = weighed.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)), F.count(F.when(full, 1)), F.sum(F.when(full, 0).otherwise(F.col("w")))).first()
        if n == capped or not open_weight:
            break
        level, capped = (everything - paid) / open_weight, n
    target = F.lit(0.0) if level is None else F.when(F.col("cap") <= level * F.col("w"), F.col("cap").cast("double")).otherwise(level * F.col("w"))
    return weighed.select("source", "source_size", target.alias("target"))


def _end(words: DataFrame, plan: DataFrame, by: str) -> DataFrame:
    """(s, last, before): the place ``by`` at which the sum of ``words`` (source, ``by``, words), after what came before it, fills a budget."""
    upto = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    sums = words.groupBy("source", by).agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    filled = sums.join(plan.select("s", "budget", "before"), F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", F.col("before") + F.col("upto")).where("upto >= budget")
    return filled.groupBy("s").agg(F.min(F.struct(by, (F.col("upto") - F.col("words")).alias("before"))).alias("end")).select(F.col("s").alias("t"), F.col(f"end.{by}").alias(f"last_{by}"), F.col("end.before").alias("until"))


def taken(sized: DataFrame) -> DataFrame:
    """``sized`` (source, size, doc_id, key, bin, fine, any more) with source_size, target and taken, the words the mix takes.

    The document in which the budget ends is taken if at least half of it fits. Equal keys go by doc_id, nulls last.
    """
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "s").withColumn("before", F.lit(0).cast("long"))
    for by in ("bin", "fine"):
        rows = sized if by == "bin" else sized.join(plan.select(F.col("s").alias("of"), "last_bin"), F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("last_bin")))
        end = _end(rows.select("source", by, "size"), plan, by)
        plan = materialize(plan.join(end, F.col("s").eqNullSafe(F.col("t")), "left").withColumn("before", F.coalesce("until", "before")).drop("t", "until"), "plan")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    last = Window.partitionBy("source").orderBy(F.desc("key"), F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    at_end = rows.where("bin = last_bin AND fine = last_fine").withColumn("prefix", F.col("before") + F.sum("size").over(last) - F.col("size")).withColumn("extra", F.when(F.col("prefix") + F.col("size") / 2 <= F.col("budget"), F.col("size")).otherwise(0)).drop("prefix")
    after = (F.col("bin") > F.col("last_bin")) | ((F.col("bin") == F.col("last_bin")) & (F.col("fine") > F.col("last_fine")))
    others = rows.where("NOT (bin <=> last_bin AND fine <=> last_fine)").withColumn("extra", F.when(after, 0).otherwise(F.col("size")))
    done = at_end.unionByName(others).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long"))
    return done.drop("epochs", "budget", "last_bin", "last_fine", "before", "extra")


def place(key: Column) -> Column:
    """From 0 for the largest keys to under 1 for the smallest: the logarithm of the exponential that a key stands for."""
    of = (F.log(-F.log(key)) - LEAST_LOG) / (MOST_LOG - LEAST_LOG)
    return F.when(key <= 0, 1 - 2.0**-30).when(key >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1 - 2.0**-30), of)))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    size = size_of(F.col("text"))
    sized = docs.select("doc_id", "source", size.alias("size"), quality(size, F.col("text")).alias("weight"), *more)
    keyed = materialize(sized.withColumn("key", sampling_key(F.col("doc_id"), F.col("weight"))).drop("weight"), "keyed")
    cell = F.floor(place(F.col("key")) * BINS * BINS)  # after the texts are read: a key that is named often would be computed as often
    return keyed.withColumns({"bin": F.floor(cell / BINS).cast("int"), "fine": (cell % BINS).cast("int")})


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs`` (doc_id, source, text).

    Null texts have size 0 and a target of 0 where a source has no words. A null source is a source. Repeated rows count and are
    taken on their own. Reruns agree, as keys come from doc_id alone. Other columns are not read.
    """
    return taken(_keyed(docs)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns."""
    columns = all_columns(docs)
    row, often, copy = free_names(docs, "row", "often", "copy")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    times = taken(_keyed(rows, F.col(row))).where("taken > 0").select(row, (F.col("taken") / F.col("size")).cast("int").alias(often))
    return rows.join(times, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, source, size, power(((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT)::DOUBLE + 0.5) / {float(1 << 60)!r}::DOUBLE,
    1 / greatest({LEAST_WEIGHT}::DOUBLE, size::DOUBLE / greatest(size + symbols, 1))) AS key
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS size,
    coalesce(len(regexp_extract_all(text, '{SYMBOL}')), 0)::BIGINT AS symbols FROM documents)),
s AS (
  SELECT source, source_size, {MOST_EPOCHS} * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
o AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY cap::DOUBLE / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM s),
l AS (SELECT arg_min(level, cap::DOUBLE / w) FILTER (cap > level * w) AS level FROM o),
t AS (SELECT source, source_size, CASE WHEN cap <= l.level * w THEN cap::DOUBLE ELSE l.level * w END AS target FROM s, l),
b AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY key DESC, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS prefix
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + CASE WHEN prefix + size / 2.0 <= target - epochs * source_size THEN size ELSE 0 END)::BIGINT AS taken FROM b
"""
