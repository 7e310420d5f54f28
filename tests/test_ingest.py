import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.models import HashEmbedder
from corpusmill.operators import extract, lexical, sync
from corpusmill.plans import ingest
from corpusmill.plans.base import ORACLES, QUERIES, SITE
from corpusmill.sources import markup
from corpusmill.streaming.sync import PAGES, Store, apply, follow

LONG = "Este es un texto con bastantes palabras para formar una sección."


def page(body):
    return f"<html><body>{body}</body></html>"


def sections(spark, *bodies):
    rows = spark.createDataFrame([(str(i), page(b)) for i, b in enumerate(bodies)], "url string, html string")
    return [r for r in extract.sectionise(markup.read_pages(rows)).orderBy("url").collect()]


def test_catalog(spark):
    rows = {r.root_url: r for r in ingest.catalog_parse(spark, "").collect()}
    assert set(rows) == {f"{SITE}/historia/uno", f"{SITE}/historia/dos", f"{SITE}/bio/tres"}
    assert rows[f"{SITE}/historia/uno"].title == "Uno again" and rows[f"{SITE}/historia/uno"].subject_slug == "biologia"
    assert rows[f"{SITE}/historia/dos"].title == "Dos & más" and rows[f"{SITE}/historia/dos"].subject == "Historia Universal"
    assert rows[f"{SITE}/historia/uno"].position < rows[f"{SITE}/historia/dos"].position


def test_sitemaps(spark):
    rows = ingest.sitemap_parse(spark, "").collect()
    assert sum(r.kind == "index" for r in rows) == 3
    got = {(r.url, r.lastmod) for r in ingest.sitemap_expand(spark, "").collect()}
    assert got == {(f"{SITE}/historia/uno", "2026-01-01T10:00Z"), (f"{SITE}/historia/uno/a", None)}


def test_pages_of_objects(spark):
    objects = spark.createDataFrame([(0, "h://s/a", "A", "X", "x"), (1, "h://s/a/b", "B", "X", "x"), (2, "h://s/c", "C", "Y", "y")], "position int, root_url string, title string, subject string, subject_slug string")
    entries = spark.createDataFrame([(0, "h://s/a", "1"), (1, "h://s/a/b/z", None), (2, "h://s/ab", "2"), (3, "h://s/a/b/z", "later")], "position int, url string, lastmod string")
    got = {r.url: (r.title, r.lastmod) for r in sync.match_pages(objects, entries).collect()}
    assert got == {"h://s/a": ("A", "1"), "h://s/a/b/z": ("A", None), "h://s/c": ("C", None)}  # B's one page is A's already
    assert {r.url for r in sync.match_pages(objects, entries, "y").collect()} == {"h://s/c"}
    assert sync.match_pages(objects, entries, limit=0).count() == 1


CUT = f"<main><h1>Uno &amp; dos token = &quot</h1><p>{LONG} &lt;a&gt; &quot;b&quot; &amp c &quo</p><p>{LONG} &copy; &#233; x&lt3 &nosuch; ?a=1&copy=2</p></main>"


def test_blocks_keep_cut_references(spark):
    (row,) = sections(spark, CUT)
    assert [i.text for i in row["items"]] == ["Uno & dos token = &quot", f"{LONG} <a> \"b\" & c &quo", f"{LONG} © é x&lt3 &nosuch; ?a=1&copy=2"]


def test_title_keeps_cut_references(spark):
    (row,) = sections(spark, CUT)
    assert row.title == "Uno & dos token = &quot"


def test_sections_keep_cut_references(spark):
    (row,) = sections(spark, CUT)
    assert [s.heading for s in row.sections] == ["Uno & dos token = &quot"] and row.sections[0].blocks[0].endswith("<a> \"b\" & c &quo")


def against_sql(spark, folder, name, *titles):
    """The rows of a query and of its SQL that only one of them has, over pages of these titles as markup."""
    rows = [(i, f"u{i}", None if t is None else page(f"<article><h1>{t}</h1><p>{LONG}</p><p>dos &amp; tres</p></article>")) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    got = QUERIES[name](spark, str(folder)).select(*(c[0] for c in want.description))
    return {tuple(r) for r in got.collect()} ^ set(want.fetchall())


CUT_TITLES = ["token = &quot;x&quot; y&amp;&quot;z"[:k] for k in range(34)]


def test_titles_cut_anywhere_match_their_sql(spark, tmp_path):
    assert not against_sql(spark, tmp_path, "extract_title", *CUT_TITLES)


def test_a_null_page_has_no_title(spark, tmp_path):
    assert not against_sql(spark, tmp_path, "extract_title", "Uno", None, "")
    assert {r.url: r.title for r in QUERIES["extract_title"](spark, str(tmp_path)).collect()}["1"] is None


def test_sections_cut_anywhere_match_their_sql(spark, tmp_path):
    assert not against_sql(spark, tmp_path, "sectionise", *CUT_TITLES[1:])


def test_sections_without_a_heading_match_their_sql(spark, tmp_path):
    assert not against_sql(spark, tmp_path, "sectionise", "", " ", "Uno")


def test_main_block_and_sections(spark):
    a, b, c, d, e, f = sections(
        spark,
        f"<nav>x</nav><main><h1>Título</h1><p>{LONG}</p><p>{LONG}</p><header>no</header><h2>Corta</h2><p>poco</p><h2>Lista</h2><ul><li>{LONG}<p>dentro</p></li><li>{LONG} dos</li></ul></main><footer>z</footer>",
        f"<a id=main-content></a><section><h1>Vieja</h1><div class='field--name-body'>{LONG}</div></section>",
        f"<div id=main-content><h1>D</h1><div class='breadcrumb'>no</div><p>{LONG}<p>Menu<p>{LONG} y más</div>",
        f"<div><h1>Sin contenedor</h1><p>{LONG}</p></div>",
        "<main><h1>Vacía</h1><p>corto</p></main>",
        f"<main><p>{LONG}</p><table><tr><td>{LONG}<td>celda</table></main>",
    )
    assert a.title == "Título" and [(s.heading, s.blocks) for s in a.sections] == [("Título", [LONG]), ("Lista", [f"{LONG} dentro", f"{LONG} dos"])]
    assert [(s.heading, s.blocks) for s in b.sections] == [("Vieja", [LONG])]
    assert [(s.heading, s.blocks) for s in c.sections] == [("D", [LONG, f"{LONG} y más"])]
    assert d.error == markup.NO_MAIN and e.error == markup.NO_TEXT and f.error is None
    assert f.sections[0].blocks[1] == f"{LONG} celda"


def test_citation():
    root = markup.parse(page("<main><p>¿Cómo citar este objeto de aprendizaje</p><p>Autoría, A. (2020).</p><a>https://s.example/x</a> y más</main>"))
    assert markup.citation(root) == "Autoria, A. (2020). https://s.example/x"
    assert markup.citation(markup.parse("<p>nada</p>")) is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .", max_size=200), st.integers(5, 40))
def test_pieces_keep_the_text_in_order(text, most):
    pieces = extract.cut_block(text, most)
    assert "".join("".join(p.split()) for p in pieces) == "".join(text.split())
    assert all(len(p) <= most + 1 for p in pieces)  # a hard cut takes one more, also where it uses the text up


def test_hard_cut_takes_one_more():
    assert extract.cut_block("x" * 25, 10) == ["x" * 11, "x" * 11, "xxx"]
    assert extract.cut_block("a" * 18, 5) == ["a" * 6] * 3


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_chunks(seed):
    rng = random.Random(seed)
    parts = [(f"h{k}", [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 5))]) for k in range(3)]
    got = extract.chunks_of(parts, 120, 30)
    assert [o for o, _, _ in got] == list(range(len(got)))
    assert all(len(t) <= 121 + 2 + 30 for _, _, t in got)
    for heading, blocks in parts:
        own = [t for _, h, t in got if h == heading]
        assert bool(own) == bool(blocks)
        for piece in (p for b in blocks for p in extract.cut_block(b, 120)):
            assert any(piece in t for t in own)


def test_overlap_starts_on_a_word():
    got = extract.chunks_of([("h", ["palabra " * 20, "otra " * 20])], 220, 30)
    assert len(got) == 2 and got[1][2].split("\n\n")[0] == "palabra palabra palabra"


def test_decision_table(spark):
    pages = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", None), ("e", "2"), ("f", "")], "url string, lastmod string")
    docs = spark.createDataFrame([("a", "1", "1"), ("b", "1", "0"), ("c", None, "1"), ("f", "", "1")], "url string, lastmod string, processor_version string")
    skips = spark.createDataFrame([("d", None, "2"), ("e", "2", "1")], "url string, lastmod string, processor_version string")
    got = {r.url: r.action for r in sync.plan(pages, docs, skips).collect()}
    assert got == {"a": "skip", "b": "fetch", "c": "fetch", "d": "skip", "e": "fetch", "f": "fetch"}
    fetched = spark.createDataFrame(
        [("n", None, 2, "h"), ("u", None, 2, "h2"), ("s", None, 2, "h"), ("v", None, 2, "h"), ("z", None, 0, "h"), ("g", "http 404 Not Found", 0, None), ("m", markup.NO_MAIN, 0, None), ("x", "http 503", 0, None)],
        "url string, error string, n_chunks int, content_hash string",
    )
    stored = spark.createDataFrame([("u", "h", "1"), ("s", "h", "1"), ("v", "h", "0")], "url string, content_hash string, processor_version string")
    got = {r.url: r.outcome for r in sync.outcome(fetched, stored).collect()}
    assert got == {"n": "inserted", "u": "updated", "s": "unchanged", "v": "updated", "z": "failed", "g": "skipped", "m": "skipped", "x": "failed"}


def body(n):
    return page(f"<main><h1>T</h1><p>{LONG} {n}</p></main>")


def test_sync_into_a_store_and_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), slots=3)
    first = spark.createDataFrame([("a", "1", "A", "s", body(1)), ("b", None, "B", "s", body(2)), ("c", "1", "C", "s", page("nothing"))], PAGES)
    r = apply(store, first, 0).first()
    assert (r.discovered, r.fetched, r.inserted, r.skipped, r.status) == (3, 3, 2, 1, "completed")
    assert store.read("chunks").count() == 2 and store.read("skips").first().url == "c"
    chunks = store.read("chunks")
    store.save_vectors(chunks.select("url", "ordinal", F.array(F.lit(1.0).cast("float")).alias("vector")), "m")
    assert store.read("chunks").where("embedding IS NOT NULL").count() == 2
    second = spark.createDataFrame([("a", "1", "A", "s", body(9)), ("b", None, "B", "s", body(2)), ("c", "1", "C", "s", body(3)), ("d", "1", "D", "s", body(4))], PAGES)
    r = apply(store, second, 2).first()
    assert (r.discovered, r.inserted, r.updated, r.unchanged, r.skipped) == (4, 1, 0, 1, 2)
    r = apply(store, second.where("url = 'a'").withColumn("lastmod", F.lit("2")), 3).first()
    assert r.updated == 1
    rows = {r.url: r.embedding for r in store.read("chunks").collect()}
    assert rows["a"] is None and rows["b"] == [1.0] and rows["d"] is None
    version = store.version()
    again = apply(store, second.where("url = 'a'").withColumn("lastmod", F.lit("2")), 3).first()
    assert again.updated == 1 and store.read("chunks").count() == 3 and store.version() == version
    assert {r.url: r.embedding for r in store.read("chunks").collect()} == rows
    log = store.runs().orderBy("run_id").collect()
    assert [(r.batch, r.status) for r in log] == [(0, "completed"), (2, "completed"), (3, "completed")] and all(r.finished_at >= r.started_at for r in log)
    document = store.read("documents").where("url = 'a'").first()
    assert document.object_title == "A" and document.title == "T" and LONG in document.clean_text
    assert store.read("skips").count() == 1 and store.read("skips").first().checked_at is not None


def test_vectors_survive_batches_and_embedding_goes_on_where_it_stopped(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), slots=4)
    pages = lambda *urls: spark.createDataFrame([(u, "1", u, "s", body(u)) for u in urls], PAGES)
    apply(store, pages("a", "b", "c"), 0)
    model = HashEmbedder(4)
    assert store.embed_pending(model, limit=1, batch_rows=1) == (1, 2)
    apply(store, pages("d"), 1)
    assert [r.url for r in store.read("chunks").where("embedding IS NOT NULL").collect()] == ["a"]
    apply(store, pages("d"), 1)
    assert store.embed_pending(model, batch_rows=2) == (3, 0)
    assert store.embed_pending(model) == (0, 0)
    apply(store, spark.createDataFrame([("a", "2", "a", "s", body("new"))], PAGES), 2)
    assert {r.url for r in store.read("chunks").where("embedding IS NULL").collect()} == {"a"}


def test_a_batch_writes_its_own_slots_and_old_folders_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), slots=50)
    apply(store, spark.createDataFrame([(u, "1", u, "s", body(u)) for u in "abcdefgh"], PAGES), 0)
    before = store.manifest()["tables"]["documents"]
    apply(store, spark.createDataFrame([("a", "2", "a", "s", body("x"))], PAGES), 1)
    after = store.manifest()["tables"]["documents"]
    (slot,) = store.touched(spark.createDataFrame([("a",)], "url string"))
    assert {k for k in after if after[k] != before.get(k)} == {str(slot)}
    for n in range(2, 4):
        apply(store, spark.createDataFrame([("a", str(n + 1), "a", "s", body(n))], PAGES), n)
    kept = sorted(int(p.name) for p in (tmp_path / "store/data/documents").iterdir() if p.name.isdigit())
    assert kept[0] == 1 and len(kept) <= 3 and len([p for p in (tmp_path / "store/versions").iterdir() if p.name.isdigit()]) == 2
    assert store.read("documents").count() == 8


def test_a_failed_batch_changes_nothing_and_is_logged(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    apply(store, spark.createDataFrame([("a", "1", "a", "s", body(1))], PAGES), 0)
    monkeypatch.setattr(Store, "commit", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        apply(store, spark.createDataFrame([("b", "1", "b", "s", body(1))], PAGES), 1)
    monkeypatch.undo()
    assert [r.url for r in store.read("documents").collect()] == ["a"] and store.runs().where("run_id = 2").first().status == "failed"
    assert apply(store, spark.createDataFrame([("b", "1", "b", "s", body(1))], PAGES), 1).first().inserted == 1


def test_the_stored_index_is_kept_up(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), slots=4)
    apply(store, spark.createDataFrame([(u, "1", u, "s", body(t)) for u, t in (("a", "volcán"), ("b", "río"))], PAGES), 0)
    apply(store, spark.createDataFrame([("a", "2", "a", "s", body("montaña"))], PAGES), 1)
    asked = spark.createDataFrame([(1, "volcan"), (2, "montana"), (3, "río texto")], "qid long, question string")
    kept = lexical.search(store.index(), asked).select("qid", "chunk_id", "bm25").collect()
    chunks = store.read("chunks").join(store.read("documents").select("url", "title", "subject"), "url").withColumn("chunk_id", F.concat_ws("#", "url", "ordinal"))
    fresh = lexical.bm25_topk(asked, chunks).select("qid", "chunk_id", "bm25").collect()
    assert sorted(kept) == sorted(fresh) and {r.qid for r in kept} == {2, 3}


def test_no_space_no_run(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), least_space=1 << 60)
    with pytest.raises(RuntimeError):
        apply(store, spark.createDataFrame([("a", "1", "a", "s", body(1))], PAGES), 0)
    assert store.version() is None and store.runs().count() == 0


def test_stream_of_pages(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), Store(spark, str(tmp_path / "store"))
    spark.createDataFrame([("a", "1", "A", "s", body(1))], PAGES).write.parquet(landing)
    follow(spark, landing, store, str(tmp_path / "marks")).awaitTermination()
    spark.createDataFrame([("a", "2", "A", "s", body(2)), ("b", "1", "B", "s", body(3))], PAGES).write.mode("append").parquet(landing)
    follow(spark, landing, store, str(tmp_path / "marks")).awaitTermination()
    assert {r.url: r.lastmod for r in store.read("documents").collect()} == {"a": "2", "b": "1"}
    assert store.version() == 2
