"""Queries on discovery, extraction, chunks, sync and audit.

Stored states are derived from the tables: a document's length and language say whether it is new, changed, skipped or gone.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import urls
from corpusmill.operators import audit, extract, sync
from corpusmill.plans.base import CORPUS, SETTINGS, SITE, corpus, literal, query, values
from corpusmill.sources import markup
from corpusmill.storage import materialize, numbered, table

# --- catalogue and sitemaps: literal inputs
CATALOG = """<html><body><h4><a href="/early">Early</a></h4><main><h3>Historia Universal</h3><h5><a href="/historia/uno/">Uno</a></h5>
<h5><a href="https://elsewhere.example/x">Away</a></h5><h4>No link</h4><h5><a href="/historia/dos">Dos &amp; más</a></h5><h3>Biología</h3>
<h5><a href="/historia/uno">Uno again</a></h5><h5><a href="files/a.PDF">File</a></h5><h5><a href="../bio/tres?x=1#y">Tres</a></h5></main></body></html>"""
_NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
SITEMAPS = [
    (f"{SITE}/sitemap.xml", f"<sitemapindex {_NS}><sitemap><loc> {SITE}/s1.xml </loc></sitemap><sitemap><loc>{SITE}/s2.xml</loc></sitemap><sitemap><loc></loc></sitemap></sitemapindex>"),
    (f"{SITE}/s1.xml", f"<urlset {_NS}><url><loc>{SITE}/historia/uno</loc><lastmod>2026-01-01T10:00Z</lastmod></url><url><loc> {SITE}/historia/uno/a </loc><lastmod></lastmod></url><url><lastmod>2026</lastmod></url></urlset>"),
    (f"{SITE}/s2.xml", f"<sitemapindex {_NS}><sitemap><loc>{SITE}/s3.xml</loc></sitemap></sitemapindex>"),
    (f"{SITE}/s3.xml", f"<urlset {_NS}><url><loc>{SITE}/deep</loc></url></urlset>"),
]


_OBJECTS_READ = [
    (SITE, 1, f"{SITE}/historia/uno", "Uno again", "Biología", "biologia"),
    (SITE, 4, f"{SITE}/historia/dos", "Dos & más", "Historia Universal", "historia-universal"),
    (SITE, 8, f"{SITE}/bio/tres", "Tres", "Biología", "biologia"),
]


@query(f"SELECT base, position::INTEGER AS position, root_url, title, subject, subject_slug FROM {values(_OBJECTS_READ, 'base, position, root_url, title, subject, subject_slug')}")
def catalog_parse(spark, sf_dir):
    return markup.parse_catalog(literal(spark, [(SITE, CATALOG)], "base string, html string"))


def _sitemaps(spark):
    return literal(spark, SITEMAPS, "source string, xml string")


_PAGES_READ = [(1, 0, "page", f"{SITE}/historia/uno", "2026-01-01T10:00Z"), (1, 1, "page", f"{SITE}/historia/uno/a", None), (3, 0, "page", f"{SITE}/deep", None)]
_ENTRIES_READ = [(SITEMAPS[k][0], *row) for k, *row in [(0, 0, "index", f"{SITE}/s1.xml", None), (0, 1, "index", f"{SITE}/s2.xml", None), (2, 0, "index", f"{SITE}/s3.xml", None), *_PAGES_READ]]


@query(f"SELECT source, pos::INTEGER AS pos, kind, url, lastmod FROM {values(_ENTRIES_READ, 'source, pos, kind, url, lastmod')}")
def sitemap_parse(spark, sf_dir):
    return markup.parse_sitemaps(_sitemaps(spark))


@query(f"SELECT url, lastmod FROM {values([r[3:] for r in _PAGES_READ[:2]], 'url, lastmod')}")
def sitemap_expand(spark, sf_dir):
    return markup.expand_sitemaps(SITEMAPS[0][0], _sitemaps(spark))


# --- pages of objects: the first path segment of each page is an object of its site, in order of its address
_ROOT = "^([a-z]+://[^/?#]+/[^/?#]*)"
_ENTRIES = "entries AS (SELECT url, 'v' || length(html) AS lastmod, page_id AS position FROM pages)"
_OBJECTS = f"""objects AS (SELECT root_url, row_number() OVER (ORDER BY root_url) AS position, 'T ' || root_url AS title, regexp_extract(root_url, '([^/]*)$', 1) AS subject FROM
  (SELECT DISTINCT regexp_extract(url, '{_ROOT}', 1) AS root_url FROM pages UNION SELECT '{SITE}/empty'))"""


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url", F.concat(F.lit("v"), F.length("html").cast("string")).alias("lastmod"), F.col("page_id").alias("position"))


def _objects(spark, sf_dir):
    roots = table(spark, sf_dir, "pages").select(F.regexp_extract("url", _ROOT, 1).alias("root_url")).unionByName(literal(spark, [(f"{SITE}/empty",)], "root_url string")).distinct()
    subject = F.regexp_extract("root_url", "([^/]*)$", 1)
    placed = numbered(roots, "root_url", "position")
    return placed.select("root_url", "position", F.concat(F.lit("T "), "root_url").alias("title"), subject.alias("subject"), T.slug(subject).alias("subject_slug"))


_MATCHED = f"""{_ENTRIES}, {_OBJECTS},
m AS (SELECT coalesce(e.url, o.root_url) AS url, e.lastmod, o.root_url, o.title, o.subject, o.position, e.position AS entry_position FROM objects o LEFT JOIN entries e ON e.url = o.root_url OR starts_with(e.url, o.root_url || '/')),
matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY position, entry_position NULLS LAST) AS k FROM m) WHERE k = 1)"""


@query(f"WITH {_MATCHED} SELECT url, lastmod, root_url, title, subject FROM matched")
def match_pages(spark, sf_dir):
    return sync.match_pages(_objects(spark, sf_dir), _entries(spark, sf_dir)).drop("subject_slug")


_SUBJECT = "fr"


@query(f"WITH {_MATCHED.replace('FROM objects o LEFT', f"FROM (SELECT * FROM objects WHERE subject = '{_SUBJECT}') o LEFT")} SELECT url, lastmod, root_url, title FROM matched")
def match_subject(spark, sf_dir):
    """The pages of one subject's objects."""
    return sync.match_pages(_objects(spark, sf_dir), _entries(spark, sf_dir), _SUBJECT).drop("subject_slug", "subject")


@query(f"WITH {_OBJECTS} SELECT subject, count(*) AS objects, min(position)::INTEGER AS first_position FROM objects GROUP BY subject")
def subject_counts(spark, sf_dir):
    return audit.subject_counts(_objects(spark, sf_dir)).drop("subject_slug")


# --- extraction: the pages, and some that are bad or cite themselves
_LONG = "Palabras suficientes para que la sección de esta página se conserve entera."
_SPECIAL = [
    ("-1", "<div><h1>No block holds this heading</h1><p>x</p></div>"),
    ("-2", "<main><h1>Short</h1><p>too short</p></main>"),
    ("-3", ""),
    ("-4", f"<main><h1>Cita</h1><p>{_LONG}</p><p>Cómo citar este objeto de aprendizaje Autoría, A. (2020). https://s.example/x</p><p>y más</p></main>"),
]
_CITED = "Autoria, A. (2020). https://s.example/x"
_SPECIAL_BLOCKS = [("-2", 0, "h", "Short"), ("-2", 1, "b", "too short"), ("-4", 0, "h", "Cita"), ("-4", 1, "b", _LONG), ("-4", 2, "b", "Cómo citar este objeto de aprendizaje Autoría, A. (2020). https://s.example/x"), ("-4", 3, "b", "y más")]
_UNESCAPED = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39))"
_PLAIN = r"trim(regexp_replace(regexp_replace(" + _UNESCAPED.format(r"regexp_replace(t, '<[^>]*>', ' ', 'g')") + r", '&amp;?', '&', 'g'), '\s+', ' ', 'g'))"
_BLOCKS = rf"""parts AS (SELECT page_id::VARCHAR AS url, string_split_regex(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<h1>|<p>')[2:] AS l FROM pages),
found AS (SELECT url, generate_subscripts(l, 1) AS k, CASE WHEN generate_subscripts(l, 1) = 1 THEN 'h' ELSE 'b' END AS kind, unnest(l) AS t FROM parts),
plain AS (SELECT url, k, kind, {_PLAIN} AS text FROM found),
blocks AS (SELECT url, row_number() OVER (PARTITION BY url ORDER BY k) - 1 AS pos, kind, text FROM plain
  WHERE CASE WHEN kind = 'h' THEN text <> '' ELSE length(text) >= 2 AND lower(trim(text, ' .')) NOT IN ({", ".join(repr(b) for b in T.BOILERPLATE)}) END
  UNION ALL SELECT url, pos, kind, text FROM {values(_SPECIAL_BLOCKS, "url, pos, kind, text")}),
sections AS (SELECT url, any_value(text) FILTER (kind = 'h') AS heading, list_aggregate(list(text ORDER BY pos) FILTER (kind = 'b' AND first), 'string_agg', chr(10)) AS blocks,
  sum(length(text) + 1) FILTER (kind = 'b' AND first) - 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY url, kind, text ORDER BY pos) = 1 AS first FROM blocks) GROUP BY url)"""


def _read(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html").unionByName(literal(spark, _SPECIAL, "url string, html string"))
    return extract.sectionise(markup.read_pages(pages))


@query(f"WITH {_BLOCKS} SELECT url, pos::INTEGER AS pos, kind, text FROM blocks")
def extract_blocks(spark, sf_dir):
    return _read(spark, sf_dir).select("url", F.posexplode("items").alias("pos", "item")).select("url", "pos", "item.kind", "item.text")


@query(rf"""SELECT page_id::VARCHAR AS url, trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;?', '&', 'g'), '&quot;', '"'), '\s+', ' ', 'g')) AS title FROM pages
UNION ALL SELECT url, title FROM {values([("-1", ""), ("-2", "Short"), ("-3", ""), ("-4", "Cita")], "url, title")}""")
def extract_title(spark, sf_dir):
    return _read(spark, sf_dir).select("url", "title")


@query(f"WITH {_BLOCKS} SELECT url, 0 AS section_no, heading, blocks FROM sections WHERE n >= {extract.LEAST_SECTION}")
def sectionise(spark, sf_dir):
    """The sections of pages. One before any heading has none."""
    rows = _read(spark, sf_dir).select("url", F.posexplode("sections").alias("section_no", "s"))
    return rows.select("url", "section_no", F.nullif("s.heading", F.lit("")).alias("heading"), F.array_join("s.blocks", "\n").alias("blocks"))


@query(f"WITH {_BLOCKS} SELECT url, '{markup.NO_TEXT}' AS error FROM sections WHERE coalesce(n, 0) < {extract.LEAST_SECTION} UNION ALL SELECT url, error FROM {values([('-1', markup.NO_MAIN), ('-3', markup.NO_MAIN)], 'url, error')}")
def extract_errors(spark, sf_dir):
    return _read(spark, sf_dir).where("error IS NOT NULL").select("url", "error")


@query(f"SELECT page_id::VARCHAR AS url, NULL::VARCHAR AS citation FROM pages UNION ALL SELECT url, citation FROM {values([('-1', None), ('-2', None), ('-3', None), ('-4', _CITED)], 'url, citation')}")
def citation_extract(spark, sf_dir):
    return _read(spark, sf_dir).select("url", "citation")


# Documents as sections: the first line is the heading, the others are blocks. A null text is empty.
_LINES = "ls AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"


def _sections(spark, sf_dir):
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    section = F.struct(lines[0].alias("heading"), F.filter(lines, lambda x, i: i > 0).alias("blocks"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.array(section).alias("sections"))


@query(f"WITH {_LINES} SELECT doc_id, array_to_string(l, chr(10) || chr(10)) AS text FROM ls WHERE l[1] <> '' UNION ALL SELECT doc_id, array_to_string(l[2:], chr(10) || chr(10)) FROM ls WHERE l[1] = ''")
def document_text(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", extract.document_text(F.col("sections"), F.lit("title")).alias("text"))


_MOST = extract.MAX_CHARS
_HEAD = f"substring(rest, 1, {_MOST})"
_SENTENCE = f"CASE WHEN contains({_HEAD}, '. ') THEN length({_HEAD}) - strpos(reverse({_HEAD}), ' .') - 1 ELSE -1 END"
_GAP = f"CASE WHEN contains({_HEAD}, ' ') THEN length({_HEAD}) - strpos(reverse({_HEAD}), ' ') ELSE -1 END"
_CUT = f"CASE WHEN {_SENTENCE} >= {_MOST // 2} THEN {_SENTENCE} WHEN {_GAP} >= {_MOST // 2} THEN {_GAP} ELSE {_MOST} END"


def _pieces(source: str, key: str) -> str:
    """SQL for the pieces of ``source`` (``key``, text)."""
    return f"""r AS (SELECT {key}, text AS rest, NULL::VARCHAR AS piece, -1 AS piece_no FROM {source}
  UNION ALL SELECT {key}, CASE WHEN length(rest) > {_MOST} THEN trim(substring(rest, {_CUT} + 2), ' ' || chr(10)) ELSE '' END,
    CASE WHEN length(rest) > {_MOST} THEN trim(substring(rest, 1, {_CUT} + 1), ' ' || chr(10)) ELSE rest END, piece_no + 1 FROM r WHERE rest <> '' OR piece_no = -1)"""


@query(f"WITH RECURSIVE {_pieces("(SELECT doc_id, coalesce(text, '') AS text FROM documents)", 'doc_id')} SELECT doc_id, piece_no::INTEGER AS piece_no, piece AS text FROM r WHERE piece_no >= 0")
def split_blocks(spark, sf_dir):
    """Whole texts as blocks. A null text is empty."""
    return extract.split_blocks(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text")


_GAPS = "' ' || chr(10)"
_HELD_TAIL = f"ltrim(right(trim(held, {_GAPS}), {extract.OVERLAP}), {_GAPS})"
_TAIL = f"CASE WHEN length(trim(held, {_GAPS})) > {extract.OVERLAP} AND contains({_HELD_TAIL}, ' ') THEN substring({_HELD_TAIL}, strpos({_HELD_TAIL}, ' ') + 1) ELSE {_HELD_TAIL} END"
_OVER = f"held IS NOT NULL AND size + length(piece) + 2 > {_MOST}"
_JOIN = "chr(10) || chr(10)"


@query(f"""
WITH RECURSIVE {_LINES}, lines AS (SELECT doc_id, generate_subscripts(l[2:], 1) AS line_no, unnest(l[2:]) AS text FROM ls), {_pieces("lines", "doc_id, line_no")},
p AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, piece_no) AS n, count(*) OVER (PARTITION BY doc_id) AS last FROM r WHERE piece_no >= 0),
pk AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, NULL::VARCHAR AS held, 0::BIGINT AS size, NULL::VARCHAR AS done, last FROM p
  UNION ALL SELECT doc_id, n, CASE WHEN held IS NULL THEN piece WHEN NOT is_over THEN held || {_JOIN} || piece WHEN tail <> '' AND tail <> piece THEN tail || {_JOIN} || piece ELSE piece END,
    CASE WHEN held IS NULL THEN length(piece) WHEN NOT is_over THEN size + length(piece) + 2 WHEN tail <> '' AND tail <> piece THEN length(tail) + length(piece) + 2 ELSE length(piece) END,
    CASE WHEN is_over THEN held END, last
  FROM (SELECT p.doc_id, p.n, piece, held, size, pk.last, {_OVER} AS is_over, {_TAIL} AS tail FROM pk JOIN p ON p.doc_id = pk.doc_id AND p.n = pk.n + 1)),
c AS (SELECT doc_id, n, 0 AS k, done AS text FROM pk WHERE done IS NOT NULL UNION ALL SELECT doc_id, n, 1, held FROM pk WHERE n = last)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1)::INTEGER AS ordinal, l[1] AS heading, trim(text, {_GAPS}) AS text FROM c JOIN ls USING (doc_id)
""")
def chunk_documents(spark, sf_dir):
    return extract.chunk_documents(_sections(spark, sf_dir), "doc_id")


# --- sync
_STAMP = "CASE WHEN lang IS NULL THEN NULL ELSE 'v' || coalesce(length(text), 0) END"
_FACTS = f"facts AS (SELECT '{SITE}/' || coalesce(source, '') || '/' || doc_id AS url, coalesce(source, '') AS subject, lang, coalesce(text, '') AS text, coalesce(length(text), 0) AS n, {_STAMP} AS lastmod FROM documents)"
_OLD = "old AS (SELECT url, subject, CASE WHEN n > 1500 THEN 'older' ELSE lastmod END AS lastmod, CASE WHEN n > 3000 THEN 'other' ELSE sha256(text) END AS content_hash, CASE WHEN lang = 'es' THEN '0' ELSE '1' END AS processor_version, 't0' AS fetched_at, true AS active FROM facts WHERE lang <> 'de')"
_SKIPS = "skips AS (SELECT url, lastmod, 'old reason' AS reason, CASE WHEN n > 900 THEN '1' ELSE '2' END AS processor_version FROM facts WHERE lang = 'de' AND n < 1500)"
_PLAN = f"""{_FACTS}, {_OLD}, {_SKIPS},
planned AS (SELECT f.url, f.lastmod, CASE WHEN o.processor_version = '{sync.PROCESSOR}' AND f.lastmod <> '' AND f.lastmod = o.lastmod THEN 'unchanged lastmod'
  WHEN s.url IS NOT NULL AND s.processor_version = '{sync.SKIP_PROCESSOR}' AND f.lastmod IS NOT DISTINCT FROM s.lastmod THEN 'skipped before' ELSE 'to fetch' END AS reason
  FROM facts f LEFT JOIN old o USING (url) LEFT JOIN skips s USING (url))"""
_OUTCOME = f"""{_PLAN},
fetched AS (SELECT f.*, CASE WHEN n < 300 THEN 'http 404 Not Found' WHEN n < 400 THEN 'no text' WHEN n BETWEEN 5000 AND 5200 THEN 'http 503 Service Unavailable' END AS error, n // 500 AS n_chunks, sha256(text) AS content_hash
  FROM facts f JOIN planned p USING (url) WHERE reason = 'to fetch'),
outcomes AS (SELECT f.*, CASE WHEN error IS NOT NULL AND (contains(error, '404 Not Found') OR error IN ('no text', 'no main block')) THEN 'skipped' WHEN error IS NOT NULL OR n_chunks = 0 THEN 'failed'
  WHEN o.processor_version = '{sync.PROCESSOR}' AND o.content_hash = f.content_hash THEN 'unchanged' WHEN o.url IS NOT NULL THEN 'updated' ELSE 'inserted' END AS outcome FROM fetched f LEFT JOIN old o USING (url))"""


def _facts(spark, sf_dir):
    n = F.coalesce(F.length("text"), F.lit(0))
    url = F.concat(F.lit(f"{SITE}/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    stamp = F.when(F.col("lang").isNotNull(), F.concat(F.lit("v"), n.cast("string")))
    return table(spark, sf_dir, "documents").select(url.alias("url"), F.coalesce("source", F.lit("")).alias("subject"), "lang", F.coalesce("text", F.lit("")).alias("text"), n.alias("n"), stamp.alias("lastmod"))


def _old(facts):
    return facts.where("lang <> 'de'").select(
        "url", "subject", F.when(F.col("n") > 1500, "older").otherwise(F.col("lastmod")).alias("lastmod"), F.when(F.col("n") > 3000, "other").otherwise(T.content_hash(F.col("text"))).alias("content_hash"),
        F.when(F.col("lang") == "es", "0").otherwise("1").alias("processor_version"), F.lit("t0").alias("fetched_at"), F.lit(True).alias("active"),
    )


def _skips(facts):
    return facts.where("lang = 'de' AND n < 1500").select("url", "lastmod", F.lit("old reason").alias("reason"), F.when(F.col("n") > 900, "1").otherwise("2").alias("processor_version"))


def _planned(facts):
    return sync.plan(facts, _old(facts), _skips(facts))


def _outcomes(facts):
    error = F.when(F.col("n") < 300, "http 404 Not Found").when(F.col("n") < 400, markup.NO_TEXT).when(F.col("n").between(5000, 5200), "http 503 Service Unavailable")
    fetched = _planned(facts).where(F.col("action") == sync.FETCH).withColumns({"error": error, "n_chunks": F.floor(F.col("n") / 500), "content_hash": T.content_hash(F.col("text"))})
    return sync.outcome(fetched, _old(facts))


@query(f"WITH {_PLAN} SELECT url, lastmod, CASE reason WHEN 'to fetch' THEN 'fetch' ELSE 'skip' END AS action, reason FROM planned")
def sync_plan(spark, sf_dir):
    return _planned(_facts(spark, sf_dir)).select("url", "lastmod", "action", "reason")


@query(f"WITH {_OUTCOME} SELECT url, outcome, error FROM outcomes")
def sync_outcomes(spark, sf_dir):
    return _outcomes(_facts(spark, sf_dir)).select("url", "outcome", "error")


@query(f"""
WITH {_OUTCOME} SELECT coalesce(o.url, n.url) AS url, CASE WHEN outcome IN ('inserted', 'updated') THEN n.subject ELSE o.subject END AS subject, CASE WHEN n.url IS NOT NULL THEN n.lastmod ELSE o.lastmod END AS lastmod,
  CASE WHEN outcome IN ('inserted', 'updated') THEN n.content_hash ELSE o.content_hash END AS content_hash, CASE WHEN outcome IN ('inserted', 'updated') THEN '1' ELSE o.processor_version END AS processor_version,
  CASE WHEN n.url IS NOT NULL THEN 't1' ELSE o.fetched_at END AS fetched_at, true AS active
FROM old o FULL JOIN (SELECT * FROM outcomes WHERE outcome IN ('inserted', 'updated', 'unchanged')) n ON o.url = n.url
""")
def merge_documents(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    fresh = _outcomes(facts).withColumns({"processor_version": F.lit(sync.PROCESSOR), "fetched_at": F.lit("t1"), "active": F.lit(True)})
    return sync.merge_documents(_old(facts), fresh)


def _lines(df):
    return df.select("url", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))


def _old_chunks(facts):
    rows = _lines(facts.join(_old(facts).select("url"), "url", "left_semi"))
    return rows.select("url", "ordinal", F.sha2("text", 256).alias("text"), F.array(F.length("text").cast("float")).alias("embedding"), F.lit("m0").alias("embedding_model"))


_NEW_LINES = "SELECT url, generate_subscripts(l, 1) - 1 AS ordinal, sha256(unnest(l)) AS text FROM (SELECT url, string_split(text, chr(10)) AS l FROM {})"


@query(f"""
WITH {_OUTCOME}, changed AS (SELECT * FROM outcomes WHERE outcome IN ('inserted', 'updated')),
kept AS ({_NEW_LINES.format("facts WHERE url IN (SELECT url FROM old) AND url NOT IN (SELECT url FROM changed)")}),
fresh AS ({_NEW_LINES.format("changed")})
SELECT url, ordinal::INTEGER AS ordinal, text, 'm0' AS embedding_model FROM kept UNION ALL SELECT url, ordinal::INTEGER, text, NULL FROM fresh
""")
def merge_chunks(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    changed = materialize(_outcomes(facts).where("outcome IN ('inserted', 'updated')").select("url", "text"), "changed")
    fresh = _lines(changed).select("url", "ordinal", F.sha2("text", 256).alias("text"))
    return sync.merge_chunks(_old_chunks(facts), fresh, changed).drop("embedding")


@query(f"""
WITH {_OUTCOME}, both_ AS (SELECT *, 0 AS new FROM skips UNION ALL SELECT url, lastmod, error, '{sync.SKIP_PROCESSOR}', 1 FROM outcomes WHERE outcome = 'skipped')
SELECT url, lastmod, reason, processor_version FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY new DESC) AS k FROM both_) WHERE k = 1 AND url NOT IN (SELECT url FROM outcomes WHERE outcome IN ('inserted', 'updated'))
""")
def merge_skips(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    done = materialize(_outcomes(facts).select("url", "lastmod", "error", "outcome"), "outcomes")
    fresh = done.where("outcome = 'skipped'").select("url", "lastmod", F.col("error").alias("reason"), F.lit(sync.SKIP_PROCESSOR).alias("processor_version"))
    return sync.merge_skips(_skips(facts), fresh, done.where("outcome IN ('inserted', 'updated')"))


@query(f"""
WITH {CORPUS}, {_FACTS}, l AS (SELECT url, 0 AS ordinal, text FROM facts WHERE lang <> 'de')
SELECT l.url, ordinal::INTEGER AS ordinal, CASE WHEN e.embedding IS NOT NULL THEN 'm1' END AS embedding_model, len(e.embedding)::INTEGER AS dims FROM l JOIN corpus c ON c.url = l.url LEFT JOIN embeddings e ON e.vec_id = c.chunk_id
""")
def merge_embeddings(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    chunks = facts.where("lang <> 'de'").select("url", F.lit(0).alias("ordinal"), "text", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model"))
    new = corpus(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), "chunk_id").select("url", F.lit(0).alias("ordinal"), "vector")
    merged = sync.merge_embeddings(chunks, new, SETTINGS.embedding_model)
    return merged.select("url", "ordinal", "embedding_model", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"))


@query(f"""
WITH {_OUTCOME}, e AS (SELECT url, coalesce(error, 'no chunks') AS error FROM outcomes WHERE outcome = 'failed' ORDER BY url LIMIT {sync.MOST_ERRORS})
SELECT (SELECT count(*) FROM planned) AS discovered, count(*) FILTER (error IS NULL OR NOT starts_with(error, 'http')) AS fetched, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'updated') AS updated,
  count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'skipped') + (SELECT count(*) FROM planned WHERE reason <> 'to fetch') AS skipped, count(*) FILTER (outcome = 'failed') AS failed,
  CASE WHEN count(*) FILTER (outcome = 'failed') > 0 THEN 'completed with errors' ELSE 'completed' END AS status, (SELECT string_agg(error, chr(10) ORDER BY url) FROM e) AS error_summary FROM outcomes
""")
def run_summary(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    done = materialize(_outcomes(facts).select("url", "error", "outcome"), "outcomes")
    return sync.run_summary(_planned(facts), done)


# --- audit: long pages are indexed and short ones skipped; one indexed page is in no sitemap
_STALE = f"{SITE}/gone"
_SETS = f"""discovered AS (SELECT DISTINCT url FROM pages), indexed AS (SELECT DISTINCT url FROM pages WHERE length(html) > 2000 UNION SELECT '{_STALE}'), skipped AS (SELECT DISTINCT url FROM pages WHERE length(html) < 1500),
states AS (SELECT url, bool_or(d) AS is_discovered, bool_or(i) AS is_indexed, bool_or(s) AS is_skipped FROM (SELECT url, true AS d, false AS i, false AS s FROM discovered UNION ALL SELECT url, false, true, false FROM indexed
  UNION ALL SELECT url, false, false, true FROM skipped) GROUP BY url)"""


def _states(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    indexed = pages.where(F.length("html") > 2000).select("url").unionByName(literal(spark, [(_STALE,)], "url string"))
    return audit.url_states(pages.select("url"), indexed, pages.where(F.length("html") < 1500).select("url"))


@query(f"WITH {_SETS} SELECT url, is_discovered, is_indexed, is_skipped FROM states")
def audit_sets(spark, sf_dir):
    return _states(spark, sf_dir)


@query(f"WITH {_SETS} SELECT url FROM discovered EXCEPT SELECT url FROM indexed EXCEPT SELECT url FROM skipped")
def audit_missing(spark, sf_dir):
    return audit.missing(_states(spark, sf_dir))


@query(f"WITH {_SETS} SELECT url FROM indexed EXCEPT SELECT url FROM discovered")
def audit_stale(spark, sf_dir):
    return audit.stale(_states(spark, sf_dir))


@query(f"WITH {_ENTRIES}, {_OBJECTS} SELECT root_url FROM objects o WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.url = o.root_url OR starts_with(e.url, o.root_url || '/'))")
def audit_no_pages(spark, sf_dir):
    return audit.without_pages(_objects(spark, sf_dir), _entries(spark, sf_dir))


def _documents(spark, sf_dir):
    return corpus(spark, sf_dir).select("url", "subject", F.lit(True).alias("active"))


def _chunks(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return corpus(spark, sf_dir).select("chunk_id", "url").join(found, "chunk_id", "left")


_STATS = "stats AS (SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, count(embedding) AS embedded_chunks FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"


@query(f"WITH {_STATS} SELECT *, chunks > 0 AND chunks = embedded_chunks AS index_ready FROM stats")
def corpus_stats(spark, sf_dir):
    return audit.corpus_stats(_documents(spark, sf_dir), _chunks(spark, sf_dir))


@query("SELECT DISTINCT coalesce(source, '') AS subject FROM documents")
def indexed_subjects(spark, sf_dir):
    return audit.subjects(_documents(spark, sf_dir))


_EMPTY = "SELECT root_url FROM objects o WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.url = o.root_url OR starts_with(e.url, o.root_url || '/'))"
_BAD = f"SELECT url FROM discovered WHERE regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) <> '{SETTINGS.site}'"
_COUNTS = f"""SELECT (SELECT count(*) FROM objects) AS catalog_objects, (SELECT count(DISTINCT subject) FROM objects) AS catalog_subjects, (SELECT count(url) - count(DISTINCT url) FROM entries) AS duplicate_urls,
  (SELECT count(*) FROM discovered) AS discovered_pages, (SELECT count(*) FROM states WHERE is_discovered AND is_indexed) AS indexed_pages, (SELECT count(*) FROM states WHERE is_discovered AND is_skipped) AS skipped_pages,
  (SELECT count(*) FROM states WHERE is_discovered AND NOT is_indexed AND NOT is_skipped) AS missing_pages, (SELECT count(*) FROM states WHERE NOT is_discovered AND is_indexed) AS stale_pages,
  (SELECT count(*) FROM ({_EMPTY})) AS objects_without_pages, (SELECT count(*) FROM objects) - (SELECT count(*) FROM ({_EMPTY})) AS objects_with_pages, (SELECT count(*) FROM ({_BAD})) AS malformed_urls,
  (SELECT count(DISTINCT coalesce(source, '')) FROM documents) AS indexed_subjects, documents, chunks, embedded_chunks, chunks > 0 AND chunks = embedded_chunks AS index_ready, false AS complete FROM stats"""


@query(f"WITH {_ENTRIES}, {_OBJECTS}, {_SETS}, {_STATS} {_COUNTS}")
def audit_summary(spark, sf_dir):
    """No page of the tables is on the engine's own site, so all are malformed here."""
    documents = _documents(spark, sf_dir)
    return audit.summary(_objects(spark, sf_dir), _entries(spark, sf_dir), _states(spark, sf_dir), documents, audit.corpus_stats(documents, _chunks(spark, sf_dir)), SETTINGS)


@query(f"""
WITH {_ENTRIES}, {_OBJECTS}, {_SETS}
SELECT 'missing' AS kind, url FROM states WHERE is_discovered AND NOT is_indexed AND NOT is_skipped UNION ALL SELECT 'stale', url FROM states WHERE NOT is_discovered AND is_indexed
UNION ALL SELECT 'without_pages', root_url FROM ({_EMPTY}) UNION ALL SELECT 'malformed', url FROM ({_BAD})
""")
def audit_issues(spark, sf_dir):
    return audit.issues(_objects(spark, sf_dir), _entries(spark, sf_dir), _states(spark, sf_dir), SETTINGS)


_OF_SUBJECT = f"""{_ENTRIES.replace('entries AS', 'all_entries AS')}, {_OBJECTS.replace('objects AS', 'all_objects AS')}, objects AS (SELECT * FROM all_objects WHERE subject = '{_SUBJECT}'),
entries AS (SELECT * FROM all_entries e WHERE EXISTS (SELECT 1 FROM objects o WHERE e.url = o.root_url OR starts_with(e.url, o.root_url || '/')))"""


@query(f"WITH {_OF_SUBJECT}, {_SETS.replace('SELECT DISTINCT url FROM pages),', 'SELECT DISTINCT url FROM entries),', 1)}, {_STATS} {_COUNTS}")
def audit_subject(spark, sf_dir):
    """The audit of one subject: its objects and the sitemap entries below them, against all that is indexed."""
    objects, entries = audit.of_subject(_objects(spark, sf_dir), _entries(spark, sf_dir), _SUBJECT)
    pages, documents = table(spark, sf_dir, "pages"), _documents(spark, sf_dir)
    indexed = pages.where(F.length("html") > 2000).select("url").unionByName(literal(spark, [(_STALE,)], "url string"))
    states = audit.url_states(entries.select("url"), indexed, pages.where(F.length("html") < 1500).select("url"))
    return audit.summary(objects, entries, states, documents, audit.corpus_stats(documents, _chunks(spark, sf_dir)), SETTINGS)


@query(f"WITH {_ENTRIES} SELECT url, list_sort(list_distinct(list_transform(range(1, len(string_split(url, '/')) + 1), lambda n: array_to_string(string_split(url, '/')[1:n], '/')))) AS ancestors FROM entries")
def url_ancestors(spark, sf_dir):
    """The keys by which pages meet the roots above them."""
    return _entries(spark, sf_dir).select("url", F.sort_array(F.array_distinct(urls.ancestors(F.col("url")))).alias("ancestors"))
