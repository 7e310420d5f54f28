"""Incremental sync: what to do with each page, and keyed merges into the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import urls
from corpusmill.sources.markup import NO_MAIN, NO_TEXT
from corpusmill.storage import bounded, free_names

# Versions of the processing that stored states must match.
PROCESSOR, SKIP_PROCESSOR = "1", "2"
SKIP, FETCH = "skip", "fetch"
MOST_ERRORS = 20
MOST_OBJECTS = 200_000  # catalogue objects that are broadcast


def of_subject(objects: DataFrame, subject_slug: str | None) -> DataFrame:
    """The objects of one subject, or all."""
    return objects if subject_slug is None else objects.where(F.col("subject_slug") == subject_slug)


def match_pages(objects: DataFrame, entries: DataFrame, subject_slug: str | None = None, limit: int | None = None) -> DataFrame:
    """(url, lastmod, root_url, title, subject, subject_slug): the pages of catalogue objects (position, root_url, ...).

    A sitemap entry (position, url, lastmod) belongs to an object if it is the object's root or lies below it; of several
    objects the first in the catalogue has it. An object without entries gets its root as a page. Each URL is exploded to its
    ancestors and joined on equality, so there is no nested loop. Objects are broadcast if they are few, and the join is an inner one, so
    that no site's pages meet in one task; what has no pages is added afterwards.
    """
    chosen = bounded(of_subject(objects, subject_slug), MOST_OBJECTS, "objects")
    below = entries.select("url", "lastmod", F.col("position").alias("entry_position"), F.explode(urls.ancestors(F.col("url"))).alias("root_url"))
    found = below.join(chosen, "root_url")
    empty = chosen.join(found.select("root_url").distinct(), "root_url", "left_anti")
    alone = empty.withColumns({"url": F.col("root_url"), "lastmod": F.lit(None).cast("string"), "entry_position": F.lit(None).cast(dict(below.dtypes)["entry_position"])})
    rows = found.unionByName(alone)
    first = Window.partitionBy("url").orderBy("position", F.col("entry_position").asc_nulls_last())
    pages = rows.withColumn("k", F.row_number().over(first)).where("k = 1")
    if limit is not None:
        pages = pages.orderBy("position", F.col("entry_position").asc_nulls_last(), "url").limit(max(1, limit))
    return pages.select("url", "lastmod", "root_url", "title", "subject", "subject_slug")


def plan(pages: DataFrame, documents: DataFrame, skips: DataFrame) -> DataFrame:
    """Pages (url, lastmod) with an action, fetch or skip, and the reason, from stored states by two left joins.

    A document of this version with the same, non-empty lastmod is skipped, and so is a page skipped before with the same lastmod, of
    which two nulls are equal.
    """
    d = documents.select("url", F.col("lastmod").alias("doc_lastmod"), F.col("processor_version").alias("doc_version"))
    s = skips.select("url", F.col("lastmod").alias("skip_lastmod"), F.col("processor_version").alias("skip_version"), F.lit(True).alias("was_skipped"))
    rows = pages.join(d, "url", "left").join(s, "url", "left")
    known = (F.col("doc_version") == PROCESSOR) & (F.col("lastmod") != "") & (F.col("lastmod") == F.col("doc_lastmod"))
    skipped = F.col("was_skipped") & (F.col("skip_version") == SKIP_PROCESSOR) & F.col("lastmod").eqNullSafe(F.col("skip_lastmod"))
    reason = F.when(known, "unchanged lastmod").when(skipped, "skipped before").otherwise("to fetch")
    return rows.select(*pages.columns, F.when(known | skipped, SKIP).otherwise(FETCH).alias("action"), reason.alias("reason"))


def outcome(fetched: DataFrame, documents: DataFrame) -> DataFrame:
    """Fetched pages (url, error, n_chunks, content_hash) with their outcome by the decision table; the first that fits holds.

    skipped: gone or without content; failed: any other error, or no chunks; unchanged: same hash and version; else updated
    or inserted.
    """
    d = documents.select("url", F.col("content_hash").alias("old_hash"), F.col("processor_version").alias("old_version"), F.lit(True).alias("exists"))
    gone = T.permanently_missing(F.col("error")) | F.col("error").isin(NO_MAIN, NO_TEXT)
    what = (
        F.when(F.col("error").isNotNull() & gone, "skipped")
        .when(F.col("error").isNotNull() | (F.col("n_chunks") == 0), "failed")
        .when(F.col("exists") & (F.col("old_version") == PROCESSOR) & (F.col("old_hash") == F.col("content_hash")), "unchanged")
        .when(F.col("exists"), "updated")
        .otherwise("inserted")
    )
    return fetched.join(d, "url", "left").select(*fetched.columns, what.alias("outcome"))


def merge_documents(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``stored`` documents after ``fresh`` (outcome and the columns of a document): one full join on url.

    Inserted and updated rows replace, unchanged ones take lastmod and fetched_at and become active, all others stay.
    """
    new = fresh.where(F.col("outcome").isin("inserted", "updated", "unchanged")).select("url", "outcome", *[F.col(c).alias(f"new_{c}") for c in stored.columns if c != "url"])
    replaced, touched = F.col("outcome").isin("inserted", "updated"), F.col("outcome") == "unchanged"

    def value(c: str) -> Column:
        take = replaced | touched if c in ("lastmod", "fetched_at", "active") else replaced
        return F.when(F.coalesce(take, F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)

    return stored.join(new, "url", "full").select(*["url" if c == "url" else value(c) for c in stored.columns])


def merge_chunks(stored: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """``stored`` chunks without those of ``changed`` (url) documents, and ``fresh`` ones, which have no vector yet."""
    new = fresh.withColumns({"embedding": F.lit(None).cast("array<float>"), "embedding_model": F.lit(None).cast("string")})
    return stored.join(changed.select("url"), "url", "left_anti").unionByName(new.select(*stored.columns))


def merge_skips(stored: DataFrame, fresh: DataFrame, stored_documents: DataFrame | None = None) -> DataFrame:
    """The latest of ``stored`` and ``fresh`` skip rows for each url, without the urls of documents written since."""
    new, k = free_names(stored, "is_new", "k")
    both = stored.withColumn(new, F.lit(0)).unionByName(fresh.select(*stored.columns).withColumn(new, F.lit(1)))
    last = Window.partitionBy("url").orderBy(F.desc(new), F.col("lastmod").desc_nulls_last(), "reason")
    out = both.withColumn(k, F.row_number().over(last)).where(F.col(k) == 1).drop(k, new)
    return out if stored_documents is None else out.join(stored_documents.select("url"), "url", "left_anti")


def merge_embeddings(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """``chunks`` with the new vectors (url, ordinal, vector) of ``model`` in place of what they had."""
    rows = chunks.join(vectors.select("url", "ordinal", "vector"), ["url", "ordinal"], "left")
    new = F.col("vector").isNotNull()
    out = rows.withColumns({"embedding": F.coalesce("vector", "embedding"), "embedding_model": F.when(new, F.lit(model)).otherwise(F.col("embedding_model"))})
    return out.select(*chunks.columns)


def run_summary(planned: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: the counters of a run, and its first errors by url, joined by line feeds; null if there were none."""
    failed = F.when(F.col("outcome") == "failed", F.struct("url", F.coalesce("error", F.lit("no chunks")).alias("error")))
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    per = outcomes.agg(n("inserted"), n("updated"), n("unchanged"), n("failed"), n("skipped"), F.count_if(F.coalesce(~T.permanently_missing(F.col("error")) & ~F.col("error").startswith("http"), F.lit(True))).alias("fetched"))
    first = outcomes.select(failed.alias("e")).where("e IS NOT NULL").orderBy("e.url").limit(MOST_ERRORS).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["error"]), "\n").alias("errors"))
    before = planned.agg(F.count("*").alias("discovered"), F.count_if(F.col("action") == SKIP).alias("skipped_before"))
    out = before.join(per).join(first)
    status = F.when(F.col("failed") > 0, "completed with errors").otherwise("completed")
    return out.select("discovered", "fetched", "inserted", "updated", "unchanged", (F.col("skipped") + F.col("skipped_before")).alias("skipped"), "failed", status.alias("status"), F.nullif("errors", F.lit("")).alias("error_summary"))


def deactivate(documents: DataFrame, stale: DataFrame) -> DataFrame:
    """Opt-in: documents whose url is in ``stale`` become inactive."""
    (gone,) = free_names(documents, "is_gone")
    left = stale.select("url").distinct().withColumn(gone, F.lit(True))
    return documents.join(left, "url", "left").withColumn("active", F.col("active") & F.col(gone).isNull()).drop(gone)
