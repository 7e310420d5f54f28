"""Queries that apply column functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import temporal, urls
from corpusmill.functions import text as T
from corpusmill.plans.base import CORPUS, QUESTIONS, SETTINGS, corpus, literal, query, questions, values
from corpusmill.sources import fetch
from corpusmill.storage import table

_FOLD = "strip_accents({})"
_SLUG = "trim(regexp_replace(regexp_replace(lower(strip_accents({})), '[^\\x00-\\x7F]+', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-')"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)

#: Terms of each question: distinct, in order, the first twelve.
ASKED_TERMS = f"""{QUESTIONS},
qt AS (SELECT qid, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (SELECT qid, regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+') AS l FROM q0)),
qd AS (SELECT qid, strip_accents(t) AS term, min(pos) AS pos FROM qt WHERE (length(t) >= {T.LEAST_TERM} OR regexp_matches(t, '^[0-9]+$')) AND t NOT IN ({_STOP}) GROUP BY ALL),
asked AS (SELECT qid, term, k FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS k FROM qd) WHERE k <= {T.MOST_TERMS})"""

_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query("SELECT page_id, url, length(html) AS html_chars, sha256(html) AS html_sha256 FROM pages")
def scan_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("long").alias("html_chars"), F.sha2("html", 256).alias("html_sha256"))


@query(f"SELECT doc_id, {_CLEAN.format('text')} AS text FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("text"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, substring(text, 1, 280) AS excerpt, substring(text, 1, 650) AS context FROM documents")
def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 280).alias("excerpt"), T.excerpt(F.col("text"), 650).alias("context"))


@query(f"SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents")
def accent_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.unaccented(F.col("text")).alias("folded"))


@query(f"WITH {CORPUS} SELECT chunk_id, {_SLUG.format('title')} AS title_slug, {_SLUG.format('subject')} AS subject_slug FROM corpus")
def slugify(spark, sf_dir):
    return corpus(spark, sf_dir).select("chunk_id", T.slug(F.col("title")).alias("title_slug"), T.slug(F.col("subject")).alias("subject_slug"))


_SUFFIX = "(" + "|".join(x.replace(".", "[.]") for x in urls.IGNORED_SUFFIXES) + ")$"


@query(rf"""
WITH l AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS s, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h, list_concat([url], regexp_extract_all(html, 'href="([^"]*)"', 1)) AS hrefs FROM pages),
x AS (SELECT page_id, s, h, generate_subscripts(hrefs, 1) - 1 AS pos, unnest(hrefs) AS href FROM l),
p AS (SELECT *, regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS hs, regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS hh,
  regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS hp FROM x)
SELECT page_id, pos::INTEGER AS pos, href, CASE WHEN (hs = '' OR lower(hs) IN ('http', 'https')) AND (CASE WHEN hs = '' AND hh = '' THEN h ELSE hh END) = h AND NOT regexp_matches(lower(hp), '{_SUFFIX}')
  THEN s || '://' || h || '/' || trim(regexp_replace(hp, '/+', '/', 'g'), '/') END AS canonical FROM p
""")
def canonical_url(spark, sf_dir):
    """Each page's URL and the links in its markup, against its site."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1).alias("base"), F.concat(F.array("url"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("hrefs"))
    return pages.select("page_id", "base", F.posexplode("hrefs").alias("pos", "href")).select("page_id", "pos", "href", urls.canonical(F.col("base"), F.col("href")).alias("canonical"))


_LINKS = [
    (-1, f"https://{SETTINGS.site}/alumno/a?x=1#y"), (-2, f"https://{SETTINGS.site}/other/a?x=1"), (-3, f"https://{SETTINGS.site}/alumno//a"),
    (-4, f"https://{SETTINGS.mirror}/alumno/a"), (-5, f"https://{SETTINGS.site}//b"), (-6, f"https://{SETTINGS.site}/"),
]
_ALL_LINKS = f"u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id::BIGINT, url FROM {values(_LINKS, 'page_id, url')}), up AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM u)"
_PUBLIC = f"CASE WHEN h = '{SETTINGS.site}' AND starts_with(p, '{SETTINGS.mirrored_prefix}') THEN 'https://{SETTINGS.mirror}' || p ELSE url END"


def _links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").unionByName(literal(spark, _LINKS, "page_id long, url string"))


@query(f"WITH {_ALL_LINKS} SELECT page_id, url, {_PUBLIC} AS public_url FROM up")
def public_url(spark, sf_dir):
    return _links(spark, sf_dir).withColumn("public_url", urls.public(F.col("url"), SETTINGS.site, SETTINGS.mirror, SETTINGS.mirrored_prefix))


@query(f"WITH {_ALL_LINKS} SELECT page_id, url FROM up WHERE h <> '{SETTINGS.site}' OR contains(p, '//')")
def malformed_urls(spark, sf_dir):
    return _links(spark, sf_dir).where(urls.malformed(F.col("url"), SETTINGS.site, SETTINGS.mirror, SETTINGS.mirrored_prefix))


_RULES = [(False, "/en/"), (True, "/en/6"), (False, "/fr/8"), (False, "")]


@query(rf"""
WITH r AS {values([(int(a), p) for a, p in _RULES], "allow, prefix")},
p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, url, coalesce((SELECT arg_max(allow, length(prefix) * 2 + allow) FROM r WHERE prefix <> '' AND starts_with(p.path, prefix)) = 1, true) AS allowed FROM p
""")
def robots_filter(spark, sf_dir):
    rules = F.array(*(F.struct(F.lit(a).alias("allow"), F.lit(p).alias("prefix")) for a, p in _RULES))
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.allowed(urls.path(F.col("url")), rules).alias("allowed"))


ROBOTS = """User-agent: other
Disallow: /

User-agent: corpusmill
Disallow: /en/6  # the first rule that fits holds
Allow: /en/
Disallow: /fr/8
Disallow:
"""


@query(r"""
SELECT page_id, url, NOT (starts_with(p, '/en/6') OR (starts_with(p, '/fr/8'))) AS allowed FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)
""")
def robots_rules(spark, sf_dir):
    """By the text of a robots.txt with groups of agents."""
    return fetch.robots_allowed(table(spark, sf_dir, "pages").select("page_id", "url"), {}, "corpusmill", ROBOTS)


_TIMES = [(-1, "El 16 de septiembre de 1810 inició."), (-2, "Fue en 1821."), (-3, "En el siglo XIX hubo."), (-4, "Nada de eso."), (-5, "primero de mayo"), (-6, "el 5/2/1917 y 12-10-92"), (-7, "SIGLO IV"), (-8, "código 31810")]


@query(f"""WITH {QUESTIONS} SELECT qid, regexp_matches(question, '(?i){temporal.QUESTION}') AS temporal, regexp_matches(question, '(?i){temporal.DATE_QUESTION}') AS full_date FROM q0""")
def temporal_question(spark, sf_dir):
    q = F.col("question")
    return questions(spark, sf_dir).select("qid", temporal.found(q, temporal.QUESTION).alias("temporal"), temporal.found(q, temporal.DATE_QUESTION).alias("full_date"))


@query(f"""
WITH x AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id::BIGINT, text FROM {values(_TIMES, "doc_id, text")})
SELECT doc_id, regexp_matches(text, '(?i){temporal.FULL_DATE}') AS full_date, regexp_matches(text, '(?i){temporal.EVIDENCE}') AS evidence,
  CASE WHEN regexp_matches(text, '(?i){temporal.FULL_DATE}') THEN {temporal.DATE_BONUS}::DOUBLE WHEN regexp_matches(text, '(?i){temporal.EVIDENCE}') THEN {temporal.TIME_BONUS}::DOUBLE ELSE 0::DOUBLE END AS bonus FROM x
""")
def temporal_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(literal(spark, _TIMES, "doc_id long, text string"))
    t = F.col("text")
    return rows.select("doc_id", temporal.found(t, temporal.FULL_DATE).alias("full_date"), temporal.found(t, temporal.EVIDENCE).alias("evidence"), temporal.bonus(F.lit("cuándo"), t).alias("bonus"))


_MESSAGES = [(1, "404 Not Found"), (2, "Client error 410 Gone for url"), (3, "503 Service Unavailable"), (4, "404"), (5, None)]


@query(f"SELECT id, message, contains(message, '404 Not Found') OR contains(message, '410 Gone') AS missing FROM {values(_MESSAGES, 'id, message')}")
def missing_predicate(spark, sf_dir):
    return literal(spark, _MESSAGES, "id int, message string").withColumn("missing", T.permanently_missing(F.col("message")))


@query(f"WITH {QUESTIONS} SELECT qid, {_CLEAN.format('question')} AS question FROM q0 WHERE length(question) BETWEEN {T.LEAST_QUESTION} AND {T.MOST_QUESTION} AND length({_CLEAN.format('question')}) >= {T.LEAST_QUESTION}")
def clean_question(spark, sf_dir):
    return questions(spark, sf_dir).where(T.valid_question(F.col("question"))).withColumn("question", T.collapse(F.col("question")))


_BLOCKS = [(-1, "Menu"), (-2, "cargando..."), (-3, " Leer mas. "), (-4, "x"), (-5, "Menus del día"), (-6, "Pasar al contenido principal")]
_USEFUL = f"length(block) >= 2 AND lower(trim(block, ' .')) NOT IN ({', '.join(repr(b) for b in T.BOILERPLATE)})"


@query(f"""
WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block FROM documents UNION ALL SELECT doc_id::BIGINT, block FROM {values(_BLOCKS, "doc_id, block")})
SELECT doc_id, block, count(*) AS n FROM b WHERE {_USEFUL} GROUP BY ALL
""")
def boilerplate_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("block"))
    return lines.unionByName(literal(spark, _BLOCKS, "doc_id long, block string")).where(T.is_useful(F.col("block"))).groupBy("doc_id", "block").agg(F.count("*").alias("n"))


@query(f"WITH {ASKED_TERMS} SELECT q0.qid, coalesce(string_agg(term, ' ' ORDER BY k), '') AS terms FROM q0 LEFT JOIN asked USING (qid) GROUP BY q0.qid")
def query_tokens(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", F.array_join(T.query_tokens(F.col("question")), " ").alias("terms"))


@query(f"WITH {CORPUS} SELECT chunk_id, sha256('Asignatura: ' || subject || chr(10) || 'Recurso: ' || title || chr(10) || 'Seccion: ' || heading || chr(10) || text) AS text_sha256 FROM corpus")
def embedding_text(spark, sf_dir):
    return corpus(spark, sf_dir).select("chunk_id", F.sha2(T.embedding_text(*map(F.col, ("title", "subject", "heading", "text"))), 256).alias("text_sha256"))


