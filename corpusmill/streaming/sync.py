"""Sync as a stream: pages land as files, and each batch is planned, extracted and merged into stored tables.

Stored tables are dealt to slots by a hash of url. A batch reads and rewrites the slots of its own urls alone; a manifest names the folder of
each slot, and writing it is the commit. Versions have a counter of their own, whoever writes them, and a manifest remembers the batches that
went into it: one that is run again after its commit changes nothing, and one that failed before leaves the last version in place.
Folders that no kept manifest names are removed.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions import text as T
from corpusmill.models import Embedder
from corpusmill.operators import extract, lexical, sync, vectors
from corpusmill.sources.markup import read_pages
from corpusmill.storage import check_space, materialize

PAGES = "url string, lastmod string, title string, subject string, html string"
DOCUMENTS = (
    "url string, title string, subject string, object_title string, lastmod string, citation string, clean_text string, "
    "content_hash string, processor_version string, fetched_at timestamp, active boolean"
)
CHUNKS = "url string, ordinal int, heading string, text string, embedding array<float>, embedding_model string"
SKIPS = "url string, lastmod string, reason string, processor_version string, checked_at timestamp"
POSTINGS = "url string, chunk_id string, term string, tf long, wf double, length long"
RUN = (
    "run_id long, batch long, started_at string, finished_at string, status string, discovered long, fetched long, inserted long, "
    "updated long, unchanged long, skipped long, failed long, error_summary string"
)
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "skips": SKIPS, "postings": POSTINGS}
SLOTS = 64  # of a store; how finely changes are written
KEEP = 2  # versions that readers may still use
RUNNING = "running"


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


class Store:
    """The stored tables below one folder, which must be shared by driver and executors."""

    def __init__(self, spark: SparkSession, folder: str, slots: int = SLOTS, least_space: int | None = None):
        self.spark, self.folder, self.slots, self.least_space = spark, folder.rstrip("/"), slots, least_space
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{p}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- small files, written by the driver alone
    def _names(self, folder: str) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._path(folder))] if self._fs.exists(self._path(folder)) else []

    def _put(self, path: str, value: dict) -> None:
        """The file is there whole or not at all."""
        part = self._path(f"{path}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self._fs.delete(self._path(path), False)
        if not self._fs.rename(part, self._path(path)):
            raise RuntimeError(f"{path} can't be written in {self.folder}")

    def _get(self, path: str) -> dict:
        got = self._fs.open(self._path(path))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(got)).decode())
        finally:
            got.close()

    # --- versions
    def version(self) -> int | None:
        """The last version that was committed."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=None)

    def manifest(self) -> dict:
        at = self.version()
        return {"tables": {}, "batches": {}, "run": 0} if at is None else self._get(f"versions/{at}")

    def slot(self, url: str = "url"):
        return F.pmod(F.xxhash64(url), F.lit(self.slots)).cast("int")

    def read(self, name: str, slots: set[int] | None = None) -> DataFrame:
        """A table as of the last version, or only some of its slots; empty if there is nothing. A column that old files lack is null."""
        places = self.manifest()["tables"].get(name, {})
        paths = [f"{self.folder}/{p}" for k, p in sorted(places.items()) if slots is None or int(k) in slots]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def touched(self, rows: DataFrame) -> set[int]:
        """The slots of ``rows`` (url): at most as many numbers as there are slots."""
        return {r[0] for r in rows.select(self.slot()).distinct().collect()}

    def commit(self, slots: set[int], batch: int | None = None, run: int | None = None, **tables: DataFrame) -> int:
        """The next version: ``tables`` hold all rows of ``slots`` and replace those; other slots and tables stay as they are."""
        now = self.manifest()
        version = (self.version() or 0) + 1
        places = {name: dict(now["tables"].get(name, {})) for name in TABLES}
        for name, df in tables.items():
            where = f"data/{name}/{version}"
            df.select(*[c.split()[0] for c in TABLES[name].split(", ")]).withColumn("slot", self.slot()).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.folder}/{where}")
            written = {n.removeprefix("slot="): f"{where}/{n}" for n in self._names(where) if n.startswith("slot=")}
            places[name] = {k: p for k, p in places[name].items() if int(k) not in slots} | written
        batches = now["batches"] | ({str(batch): run} if batch is not None else {})
        self._put(f"versions/{version}", {"tables": places, "batches": batches, "run": max(now["run"], run or 0)})
        self._sweep(version)
        return version

    def _sweep(self, version: int) -> None:
        """Old manifests go, and then the folders that none of the others names."""
        for n in self._names("versions"):
            if n.isdigit() and int(n) <= version - KEEP:
                self._fs.delete(self._path(f"versions/{n}"), False)
        used = {p.rsplit("/", 1)[0] for n in self._names("versions") if n.isdigit() for t in self._get(f"versions/{n}")["tables"].values() for p in t.values()}
        for name in self._names("data"):
            for n in self._names(f"data/{name}"):
                if n.isdigit() and int(n) <= version and f"data/{name}/{n}" not in used:
                    self._fs.delete(self._path(f"data/{name}/{n}"), True)

    # --- run log
    def open_run(self, batch: int | None = None) -> int:
        """A new run in the log, as running."""
        run = max((int(n) for n in self._names("runs") if n.isdigit()), default=0) + 1
        self._put(f"runs/{run}", {"run_id": run, "batch": batch, "started_at": _now(), "status": RUNNING})
        return run

    def close_run(self, run: int, summary: dict) -> dict:
        done = self._get(f"runs/{run}") | summary | {"finished_at": _now()}
        self._put(f"runs/{run}", done)
        return done

    def runs(self) -> DataFrame:
        """(RUN) for each run that was opened; one that never ended is still running."""
        rows = [self._get(f"runs/{n}") for n in sorted((n for n in self._names("runs") if n.isdigit()), key=int)]
        return self._log(rows)

    def _log(self, rows: list[dict]) -> DataFrame:
        names = [c.split()[0] for c in RUN.split(", ")]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RUN)

    # --- index and vectors
    def index(self) -> lexical.Index:
        """The stored index, kept up with the chunks; chunks are named url#ordinal."""
        postings = self.read("postings").drop("url")
        return lexical.Index(postings, lexical.sizes(self.read("chunks"), postings))

    def save_vectors(self, found: DataFrame, model: str) -> int:
        """The next version with the vectors in ``found`` (url, ordinal, vector)."""
        slots = self.touched(found)
        return self.commit(slots, chunks=sync.merge_embeddings(self.read("chunks", slots), found, model))

    def embed_pending(self, embedder: Embedder, limit: int | None = None, batch_rows: int = 100_000) -> tuple[int, int]:
        """Vectors for pending chunks in the order of url and ordinal, ``limit`` at most; how many were made, and how many are pending.

        Each ``batch_rows`` are a version of their own: a run that stops goes on where it stopped.
        """
        made = 0
        while limit is None or made < limit:
            most = batch_rows if limit is None else min(batch_rows, limit - made)
            rows = vectors.pending(self.read("chunks"), self.read("documents"), embedder.name, most, ("url", "ordinal"))
            rows = rows.withColumn("input", T.embedding_text(*map(F.col, ("title", "subject", "heading", "text"))))
            found = materialize(vectors.embed(rows, "input", embedder).select("url", "ordinal", "vector"), "vectors")
            n = found.count()
            if not n:
                break
            self.save_vectors(found, embedder.name)
            made += n
        return made, vectors.remaining(self.read("chunks"), self.read("documents"), embedder.name).first()[0]


def apply(store: Store, pages: DataFrame, batch: int | None = None) -> DataFrame:
    """Sync ``pages`` (PAGES) into the next version; gives the run's row of the log. Of repeated urls the last lastmod counts.

    A batch that was committed before is not applied again: its row of the log is given.
    """
    done_before = store.manifest()["batches"].get(str(batch)) if batch is not None else None
    if done_before is not None:
        return store._log([store._get(f"runs/{done_before}")])
    check_space(store.spark, store.folder, *([] if store.least_space is None else [store.least_space]))
    run = store.open_run(batch)
    try:
        return store._log([_apply(store, pages, batch, run)])
    except Exception as e:
        store.close_run(run, {"status": "failed", "error_summary": str(e)[:2000]})
        raise


def _apply(store: Store, pages: DataFrame, batch: int | None, run: int) -> dict:
    pages = pages.groupBy("url").agg(F.max_by(F.struct("lastmod", "title", "subject", "html"), F.struct("lastmod", "html")).alias("p")).select("url", "p.*")
    slots = store.touched(pages)
    documents, chunks, skips, postings = (store.read(n, slots) for n in TABLES)
    planned = sync.plan(pages.drop("html"), documents, skips)
    to_fetch = pages.join(planned.where(F.col("action") == sync.FETCH).select("url"), "url", "left_semi")
    named = to_fetch.select("url", "lastmod", "subject", F.col("title").alias("object_title"))
    read = read_pages(to_fetch.select("url", "html")).join(named, "url").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "object_title"))
    read = extract.sectionise(read).withColumn("clean_text", extract.document_text(F.col("sections"), F.col("title")))
    read = read.withColumn("content_hash", T.content_hash(F.col("clean_text")))
    columns = ["url", "title", "subject", "object_title", "lastmod", "citation", "clean_text", "content_hash", "sections", "error"]
    read = materialize(read.select(*columns), "read")
    fresh_chunks = materialize(extract.chunk_documents(read.where("error IS NULL"), "url"), "chunks")
    counted = read.drop("sections").join(fresh_chunks.groupBy("url").agg(F.count("*").alias("n_chunks")), "url", "left").fillna({"n_chunks": 0})
    outcomes = materialize(sync.outcome(counted, documents), "outcomes")
    done = outcomes.where("outcome IN ('inserted', 'updated')").select("url")
    stamped = outcomes.withColumns({"processor_version": F.lit(sync.PROCESSOR), "fetched_at": F.current_timestamp(), "active": F.lit(True)})
    skipped = outcomes.where("outcome = 'skipped'").select("url", "lastmod", F.col("error").alias("reason"), F.lit(sync.SKIP_PROCESSOR).alias("processor_version"), F.current_timestamp().alias("checked_at"))
    summary = sync.run_summary(planned, outcomes).first().asDict()
    new_chunks = fresh_chunks.join(done, "url", "left_semi")
    texts = new_chunks.join(read.select("url", "title", "subject"), "url").withColumn("chunk_id", F.concat_ws("#", "url", "ordinal"))
    new_postings = lexical.postings(texts).withColumn("url", F.regexp_replace("chunk_id", "#[0-9]+$", ""))
    store.commit(
        slots,
        batch,
        run,
        documents=sync.merge_documents(documents, stamped),
        chunks=sync.merge_chunks(chunks, new_chunks, done),
        skips=sync.merge_skips(skips, skipped, done),
        postings=postings.join(done, "url", "left_anti").unionByName(new_postings.select(*postings.columns)),
    )
    return store.close_run(run, summary)


def follow(spark: SparkSession, landing: str, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Sync page files (Parquet, PAGES) as they land in a folder."""
    pages = spark.readStream.schema(PAGES).parquet(landing)
    writer = pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: apply(store, batch, n) and None)
    return (writer.trigger(availableNow=True) if once else writer).start()
