"""Coverage audit by set operations, corpus statistics, and evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import urls
from corpusmill.operators import sync
from corpusmill.settings import Settings
from corpusmill.storage import bounded


def url_states(discovered: DataFrame, indexed: DataFrame, skipped: DataFrame) -> DataFrame:
    """(url, is_discovered, is_indexed, is_skipped): the union of three sets of urls, by one aggregation."""
    flag = lambda df, k: df.select("url", *(F.lit(i == k).alias(c) for i, c in enumerate(("d", "i", "s"))))
    rows = flag(discovered, 0).unionByName(flag(indexed, 1)).unionByName(flag(skipped, 2))
    return rows.groupBy("url").agg(F.max("d").alias("is_discovered"), F.max("i").alias("is_indexed"), F.max("s").alias("is_skipped"))


def missing(states: DataFrame) -> DataFrame:
    return states.where("is_discovered AND NOT is_indexed AND NOT is_skipped").select("url")


def stale(states: DataFrame) -> DataFrame:
    return states.where("is_indexed AND NOT is_discovered").select("url")


def without_pages(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """Catalogue objects (root_url) that no sitemap entry (url) belongs to."""
    held = entries.select(F.explode(urls.ancestors(F.col("url"))).alias("root_url")).distinct()
    return objects.join(held, "root_url", "left_anti").select("root_url")


def of_subject(objects: DataFrame, entries: DataFrame, subject_slug: str) -> tuple[DataFrame, DataFrame]:
    """The objects of one subject, and the sitemap entries that belong to them: what an audit of that subject looks at."""
    chosen = sync.of_subject(objects, subject_slug)
    below = entries.select("url", F.explode(urls.ancestors(F.col("url"))).alias("root_url"))
    own = below.join(bounded(chosen.select("root_url").distinct(), sync.MOST_OBJECTS, "roots"), "root_url", "left_semi").select("url").distinct()
    return chosen, entries.join(own, "url", "left_semi")


def issues(objects: DataFrame, entries: DataFrame, states: DataFrame, settings: Settings) -> DataFrame:
    """(kind, url): what needs attention, a row for each url: missing, stale, without pages (an object's root), malformed."""
    kinds = {"missing": missing(states), "stale": stale(states), "without_pages": without_pages(objects, entries).select(F.col("root_url").alias("url")).distinct(), "malformed": malformed(states, settings)}
    out = None
    for kind, rows in kinds.items():
        named = rows.select(F.lit(kind).alias("kind"), "url")
        out = named if out is None else out.unionByName(named)
    return out


def malformed(states: DataFrame, settings: Settings) -> DataFrame:
    return states.where(F.col("is_discovered") & urls.malformed(F.col("url"), settings.site, settings.mirror, settings.mirrored_prefix)).select("url")


def summary(objects: DataFrame, entries: DataFrame, states: DataFrame, documents: DataFrame, stats: DataFrame, settings: Settings) -> DataFrame:
    """One row with all metrics, as counts. :func:`issues` has the urls behind them."""
    catalog = objects.agg(F.count_distinct("root_url").alias("catalog_objects"), F.count_distinct("subject_slug").alias("catalog_subjects"))
    pages = entries.agg(F.count("url").alias("n"), F.count_distinct("url").alias("m")).select((F.col("n") - F.col("m")).alias("duplicate_urls"))
    is_malformed = urls.malformed(F.col("url"), settings.site, settings.mirror, settings.mirrored_prefix)
    counts = states.agg(
        F.count_if("is_discovered").alias("discovered_pages"),
        F.count_if(F.col("is_discovered") & F.col("is_indexed")).alias("indexed_pages"),
        F.count_if(F.col("is_discovered") & F.col("is_skipped")).alias("skipped_pages"),
        F.count_if(F.col("is_discovered") & ~F.col("is_indexed") & ~F.col("is_skipped")).alias("missing_pages"),
        F.count_if(F.col("is_indexed") & ~F.col("is_discovered")).alias("stale_pages"),
        F.count_if(F.col("is_discovered") & is_malformed).alias("malformed_urls"),
    )
    empty = without_pages(objects, entries).agg(F.count_distinct("root_url").alias("objects_without_pages"))
    subjects_ = documents.where("active").agg(F.count_distinct("subject").alias("indexed_subjects"))
    out = catalog
    for part in (pages, counts, empty, subjects_, stats):
        out = out.join(part)
    complete = (F.col("missing_pages") == 0) & (F.col("objects_without_pages") == 0) & (F.col("malformed_urls") == 0)
    return out.withColumns({"objects_with_pages": F.col("catalog_objects") - F.col("objects_without_pages"), "complete": complete})


def corpus_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: active documents, chunks, embedded chunks, and whether the index is ready."""
    d = documents.agg(F.count_if("active").alias("documents"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded_chunks"))
    return d.join(c).withColumn("index_ready", (F.col("chunks") > 0) & (F.col("chunks") == F.col("embedded_chunks")))


def subjects(documents: DataFrame) -> DataFrame:
    return documents.where("active AND subject IS NOT NULL").select("subject").distinct().orderBy("subject")


def subject_counts(objects: DataFrame) -> DataFrame:
    """(subject_slug, subject, objects, first_position), in the order of the catalogue."""
    return objects.groupBy("subject_slug", "subject").agg(F.count("*").alias("objects"), F.min("position").alias("first_position")).orderBy("first_position")


CASE = "question string, expected_url_contains string, should_answer boolean"


def load_cases(spark, path: str) -> DataFrame:
    """Evaluation cases from a JSON array of objects; a field may be missing."""
    return spark.read.schema(CASE).option("multiLine", True).json(path)


def case_results(cases: DataFrame, hits: DataFrame, sufficient: DataFrame) -> DataFrame:
    """Cases (qid, expected, should_answer) with url_hit, sufficient and success."""
    met = cases.select("qid", "expected").join(hits.select("qid", "url"), "qid").where(F.col("url").contains(F.col("expected"))).select("qid").distinct().withColumn("hit", F.lit(True))
    rows = cases.join(met, "qid", "left").join(sufficient.select("qid", "sufficient"), "qid", "left")
    hit, enough = F.coalesce("hit", F.lit(False)), F.coalesce("sufficient", F.lit(False))
    return rows.select("qid", "should_answer", hit.alias("url_hit"), enough.alias("sufficient"), F.when(F.col("should_answer"), enough & hit).otherwise(~enough).alias("success"))


def evaluation(results: DataFrame) -> DataFrame:
    """One row: totals, recall over answerable cases and accuracy over refusals; 0.0 where there are none."""
    share = lambda own: F.coalesce(F.count_if(own & F.col("success")) / F.nullif(F.count_if(own), F.lit(0)), F.lit(0.0))
    return results.agg(
        F.count("*").alias("total"), F.count_if("success").alias("passed"),
        share(F.col("should_answer")).alias("retrieval_recall"), share(~F.col("should_answer")).alias("refusal_accuracy"),
        F.sort_array(F.collect_list(F.when(~F.col("success"), F.col("qid")))).alias("failures"),
    )
