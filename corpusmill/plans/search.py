"""Queries on search and answers. The vector of a question or chunk is the one whose vec_id is its id: a synthetic pairing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import temporal
from corpusmill.functions import text as T
from corpusmill.models import EchoGenerator, HashEmbedder
from corpusmill.operators import answers, audit, hybrid, lexical, vectors
from corpusmill.plans.base import CORPUS, SETTINGS, corpus, index, literal, query, questions, values
from corpusmill.plans.scalar import ASKED_TERMS
from corpusmill.storage import bounded, is_broadcast, materialize, table

K = 6
MOST_HITS = 1_000_000  # of all questions, to be broadcast
MODEL = SETTINGS.embedding_model


# --- lexical
_FIELDS = " UNION ALL ".join(f"SELECT chunk_id, {w} AS w, unnest(regexp_extract_all(strip_accents(lower({f})), '[\\p{{L}}\\p{{N}}]+')) AS term FROM corpus" for f, w in lexical.WEIGHTS.items())
WORDS = f"{CORPUS}, words AS ({_FIELDS}), lens AS (SELECT c.chunk_id, count(w.term) AS length FROM corpus c LEFT JOIN words w USING (chunk_id) GROUP BY ALL)"
LEXICAL = f"""{WORDS}, {ASKED_TERMS},
hits AS (SELECT term, chunk_id, sum(w) AS wf FROM words SEMI JOIN asked USING (term) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(length) AS avg_length FROM lens),
parts AS (SELECT h.term, h.chunk_id, greatest(ln((n - df + 0.5) / (df + 0.5)), {lexical.LEAST_IDF}) * wf * {lexical.K1 + 1} / (wf + {lexical.K1} * ({1 - lexical.B} + {lexical.B} * length / avg_length)) AS part
  FROM hits h JOIN dfs USING (term) JOIN lens USING (chunk_id), st),
scored AS (SELECT qid, chunk_id, count(*) AS matched, round(sum(part), 12) AS bm25 FROM asked JOIN parts USING (term) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT s.*, n_terms, row_number() OVER (PARTITION BY qid ORDER BY matched = n_terms DESC, bm25 DESC, chunk_id) AS lexical_rank
  FROM scored s JOIN (SELECT qid, count(*) AS n_terms FROM asked GROUP BY qid) USING (qid)) WHERE lexical_rank <= {lexical.TOP})"""


@query(f"WITH {WORDS} SELECT term, chunk_id, length, count(*) AS tf, sum(w)::DOUBLE AS wf FROM words JOIN lens USING (chunk_id) GROUP BY ALL")
def postings(spark, sf_dir):
    return index(spark, sf_dir).postings


@query(f"WITH {LEXICAL} SELECT qid, chunk_id, matched, n_terms, round(bm25, 6) AS bm25, lexical_rank::INTEGER AS lexical_rank FROM lex")
def bm25_topk(spark, sf_dir):
    return lexical.search(index(spark, sf_dir), questions(spark, sf_dir)).withColumn("bm25", F.round("bm25", 6))


# --- vectors
def _stored(spark, sf_dir, chunks=None):
    """Chunks, all or those given, with the vectors that they have, and their documents, all active."""
    chunks = corpus(spark, sf_dir) if chunks is None else chunks
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    rows = chunks.join(found, "chunk_id", "left").withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), MODEL))
    return rows.select("chunk_id", "url", "heading", "text", "embedding", "embedding_model"), chunks.select("url", "title", "subject", F.lit(True).alias("active"))


def _vectors(spark, sf_dir):
    return vectors.scan(*_stored(spark, sf_dir), MODEL).select("chunk_id", F.col("embedding").alias("vector"))


def _asked(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return questions(spark, sf_dir).select("qid").join(found, "qid")


SEMANTIC = f"""v AS (SELECT vec_id, embedding::DOUBLE[] AS v, greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), {vectors.LEAST_NORM}) AS n FROM embeddings),
sims AS (SELECT q0.qid, r.vec_id AS chunk_id, round(list_dot_product(a.v, r.v) / (a.n * r.n), 9) AS sim FROM q0 JOIN v a ON a.vec_id = q0.qid, v r SEMI JOIN corpus c ON c.chunk_id = r.vec_id),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, chunk_id) AS semantic_rank FROM sims) WHERE semantic_rank <= {vectors.TOP})"""


@query(f"WITH {CORPUS}, {ASKED_TERMS}, {SEMANTIC} SELECT qid, chunk_id, round(sim, 6) AS sim, semantic_rank::INTEGER AS semantic_rank FROM sem")
def semantic_topk(spark, sf_dir):
    return vectors.semantic_topk(_asked(spark, sf_dir), _vectors(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@query("SELECT count(embedding) AS n_vectors, count(DISTINCT len(embedding)) AS n_dims, max(len(embedding))::INTEGER AS dims, count(DISTINCT len(embedding)) <= 1 AS consistent FROM embeddings")
def vector_dims(spark, sf_dir):
    return vectors.dims(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector"))


@query(f"WITH {CORPUS} SELECT chunk_id, url, title, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM corpus JOIN embeddings ON vec_id = chunk_id WHERE embedding IS NOT NULL")
def vector_scan(spark, sf_dir):
    return vectors.scan(*_stored(spark, sf_dir), MODEL).select("chunk_id", "url", "title", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {CORPUS} SELECT chunk_id, url FROM corpus LEFT JOIN embeddings ON vec_id = chunk_id WHERE embedding IS NULL")
def pending_embeddings(spark, sf_dir):
    return vectors.pending(*_stored(spark, sf_dir), MODEL).select("chunk_id", "url")


_FIRST = 100


@query(f"WITH {CORPUS} SELECT chunk_id, url FROM corpus LEFT JOIN embeddings ON vec_id = chunk_id WHERE embedding IS NULL ORDER BY chunk_id LIMIT {_FIRST}")
def pending_batch(spark, sf_dir):
    """The batch that an incremental run embeds next: the limit is what it is about."""
    return vectors.pending(*_stored(spark, sf_dir), MODEL, _FIRST).select("chunk_id", "url")


@query("SELECT count(*) AS remaining FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE embedding IS NULL")
def pending_count(spark, sf_dir):
    return vectors.remaining(*_stored(spark, sf_dir), MODEL)


@query(f"""
WITH {CORPUS}, i AS (SELECT chunk_id, lower('Asignatura: ' || subject || chr(10) || 'Recurso: ' || title || chr(10) || 'Seccion: ' || heading || chr(10) || text) AS input FROM corpus LEFT JOIN embeddings ON vec_id = chunk_id WHERE embedding IS NULL),
w AS (SELECT chunk_id, sha256(unnest(regexp_extract_all(input, '[^\\s]+'))) AS h FROM i),
d AS (SELECT chunk_id, ('0x' || substr(h, 1, 2))::INTEGER % 16 AS dim, sum(CASE WHEN ('0x' || substr(h, 3, 2))::INTEGER % 2 = 1 THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL),
m AS (SELECT chunk_id, map(list(dim), list(x)) AS m FROM d GROUP BY chunk_id)
SELECT i.chunk_id, list_transform(range(16), lambda k: coalesce(m[k::INTEGER], 0)::FLOAT) AS vector FROM i JOIN m USING (chunk_id)
""")
def embed_pending(spark, sf_dir):
    """Pending chunks with vectors of the deterministic stand-in for a model."""
    chunks, documents = _stored(spark, sf_dir)
    rows = vectors.pending(chunks, documents, MODEL).withColumn("input", T.embedding_text(*map(F.col, ("title", "subject", "heading", "text"))))
    return vectors.embed(rows, "input", HashEmbedder()).select("chunk_id", "vector")


# --- hybrid
def _hits(spark, sf_dir):
    return vectors.semantic_topk(_asked(spark, sf_dir), _vectors(spark, sf_dir)), lexical.search(index(spark, sf_dir), questions(spark, sf_dir))


def _reranked(spark, sf_dir):
    """Only texts that were hit leave the scan: the hits are few, and are broadcast where that was checked."""
    fused = bounded(hybrid.fuse(*_hits(spark, sf_dir)), MOST_HITS, "fused")
    keys = fused.select("chunk_id")
    hit = materialize(corpus(spark, sf_dir).join(F.broadcast(keys) if is_broadcast(fused) else keys, "chunk_id", "left_semi"), "hit")
    with_vector = hit.join(vectors.scan(*_stored(spark, sf_dir, hit), MODEL).select("chunk_id"), "chunk_id", "left_semi")
    return hybrid.rerank(fused, questions(spark, sf_dir), with_vector)


def _found(spark, sf_dir, k=K):
    return materialize(hybrid.best(_reranked(spark, sf_dir), k), "hits")


_SHARE = "round(coalesce({}::DOUBLE / ({}::DOUBLE + semantic_rank), 0) + coalesce({}::DOUBLE / ({}::DOUBLE + lexical_rank), 0), 12)".format(hybrid.SEMANTIC_WEIGHT, hybrid.RRF, hybrid.LEXICAL_WEIGHT, hybrid.RRF)
FUSED = f"{LEXICAL}, {SEMANTIC}, fused AS (SELECT qid, chunk_id, sim, semantic_rank, lexical_rank, {_SHARE} AS rrf FROM sem FULL JOIN lex USING (qid, chunk_id))"
_EVIDENCE = "c.title || chr(10) || c.heading || chr(10) || c.text"
_BONUS = f"CASE WHEN NOT regexp_matches(question, '(?i){temporal.QUESTION}') THEN 0::DOUBLE WHEN regexp_matches({_EVIDENCE}, '(?i){temporal.FULL_DATE}') THEN {temporal.DATE_BONUS}::DOUBLE WHEN regexp_matches({_EVIDENCE}, '(?i){temporal.EVIDENCE}') THEN {temporal.TIME_BONUS}::DOUBLE ELSE 0::DOUBLE END"
RERANKED = f"""{FUSED}, reranked AS (SELECT f.*, question, c.url, c.title, c.subject, c.heading, c.text,
  round((rrf + {_BONUS}) * CASE WHEN regexp_matches(lower(c.url), '{"|".join(hybrid.PENALISED)}') THEN {hybrid.PENALTY}::DOUBLE ELSE 1::DOUBLE END, 12) AS score
  FROM fused f JOIN corpus c USING (chunk_id) JOIN q0 USING (qid) WHERE f.chunk_id IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL))"""
_ORDER = "score DESC, semantic_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id"
BEST = f"""{RERANKED}, capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, url ORDER BY {_ORDER}) AS of_url FROM reranked) WHERE of_url <= {hybrid.PER_URL}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_ORDER}) AS rank FROM capped) WHERE rank <= {K})"""


@query(f"WITH {FUSED} SELECT qid, chunk_id, semantic_rank::INTEGER AS semantic_rank, lexical_rank::INTEGER AS lexical_rank, round(rrf, 9) AS rrf FROM fused")
def hybrid_fusion(spark, sf_dir):
    return hybrid.fuse(*_hits(spark, sf_dir)).select("qid", "chunk_id", "semantic_rank", "lexical_rank", F.round("rrf", 9).alias("rrf"))


@query(f"WITH {RERANKED} SELECT qid, chunk_id, url, round(rrf, 9) AS rrf, round(score, 9) AS score FROM reranked")
def rerank(spark, sf_dir):
    return _reranked(spark, sf_dir).select("qid", "chunk_id", "url", F.round("rrf", 9).alias("rrf"), F.round("score", 9).alias("score"))


@query(f"WITH {BEST} SELECT qid, rank::INTEGER AS rank, chunk_id, url, title, subject, heading, substring(text, 1, 280) AS excerpt, round(score, 9) AS score, round(sim, 6) AS sim, lexical_rank::INTEGER AS lexical_rank FROM best")
def hybrid_search(spark, sf_dir):
    hits = hybrid.best(_reranked(spark, sf_dir), K)
    return hits.select("qid", "rank", "chunk_id", "url", "title", "subject", "heading", T.excerpt(F.col("text"), 280).alias("excerpt"), F.round("score", 9).alias("score"), F.round("sim", 6).alias("sim"), "lexical_rank")


_MARK = "b.title || chr(10) || b.heading || chr(10) || b.text"
GATE = f"""{BEST}, gate AS (SELECT q0.qid,
  coalesce((CASE WHEN NOT regexp_matches(q0.question, '(?i){temporal.QUESTION}') THEN true WHEN regexp_matches(q0.question, '(?i){temporal.DATE_QUESTION}') THEN bool_or(regexp_matches({_MARK}, '(?i){temporal.FULL_DATE}'))
    ELSE bool_or(regexp_matches({_MARK}, '(?i){temporal.EVIDENCE}')) END)
    AND (bool_or(coalesce(b.lexical_rank <= {hybrid.GOOD_RANK} AND coalesce(b.sim, 0) >= {hybrid.GOOD_SIM}, false)) OR max(coalesce(b.sim, 0)) >= {hybrid.ENOUGH_SIM}), false) AND count(b.qid) > 0 AS sufficient,
  max(CASE WHEN b.qid IS NOT NULL THEN coalesce(b.sim, 0) END) AS best_sim FROM q0 LEFT JOIN best b ON b.qid = q0.qid GROUP BY q0.qid, q0.question)"""


@query(f"WITH {GATE} SELECT qid, sufficient, round(best_sim, 6) AS best_sim FROM gate")
def evidence_gate(spark, sf_dir):
    return hybrid.gate(questions(spark, sf_dir), _found(spark, sf_dir)).withColumn("best_sim", F.round("best_sim", 6))


_NUMBERED = f"{BEST}, numbered AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY first) AS number FROM (SELECT *, min(rank) OVER (PARTITION BY qid, url) AS first FROM best))"


@query(rf"""
WITH {_NUMBERED} SELECT qid, 'Fuentes:' || chr(10) || chr(10) || string_agg('<FUENTE ' || number || '>' || chr(10) || 'Titulo: ' || title || chr(10) || 'Seccion: ' || heading || chr(10) || 'Contenido:' || chr(10)
  || substring(text, 1, {answers.MOST_CONTEXT}) || chr(10) || '</FUENTE ' || number || '>', chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Pregunta: ' || question AS prompt FROM numbered GROUP BY qid, question
""")
def prompt_context(spark, sf_dir):
    return answers.prompt_context(_found(spark, sf_dir), questions(spark, sf_dir))


@query(f"""
WITH {BEST} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank)::INTEGER AS position, title, heading, subject, url
FROM (SELECT *, row_number() OVER (PARTITION BY qid, url ORDER BY rank) AS k FROM best) WHERE k = 1
""")
def sources_list(spark, sf_dir):
    return answers.sources_list(_found(spark, sf_dir), SETTINGS)


_SOURCE = """struct_pack(title := title, heading := heading, subject := subject, url := url)"""


@query(f"""
WITH {GATE}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, url ORDER BY rank) AS k FROM best) WHERE k = 1),
src AS (SELECT qid, list({_SOURCE} ORDER BY rank) AS sources FROM first GROUP BY qid),
q AS (SELECT qid, sufficient, CASE WHEN sources IS NULL THEN '{{"type":"sources","sources":[]}}' ELSE to_json(struct_pack("type" := 'sources', sources := sources)) END AS first FROM gate LEFT JOIN src USING (qid))
SELECT qid, 0 AS seq, first AS event FROM q
UNION ALL SELECT qid, 1, to_json(struct_pack("type" := 'token', content := CASE WHEN sufficient THEN 'Fuentes:' ELSE '{answers.REFUSAL}' END)) FROM q
UNION ALL SELECT qid, 2, to_json(struct_pack("type" := 'done', refused := NOT sufficient)) FROM q
""")
def chat_events(spark, sf_dir):
    """Events for every question, answered by a stand-in for a model that repeats the prompt's first line."""
    hits, asked = _found(spark, sf_dir), questions(spark, sf_dir)
    return answers.chat(asked, hits, hybrid.gate(asked, hits), EchoGenerator(), SETTINGS)


_KIND = "\"type\" := CASE WHEN role = 'assistant' THEN 'token' ELSE 'question' END"


@query(f"SELECT conv_id, turn, CASE WHEN text IS NULL THEN to_json(struct_pack({_KIND})) ELSE to_json(struct_pack({_KIND}, content := text)) END AS event FROM conversations")
def events_ndjson(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", answers.events(F.when(F.col("role") == "assistant", "token").otherwise("question"), content=F.col("text")).alias("event"))


# --- grounding: an assistant's turns against all other turns of the conversation
_CLAIMED = [
    (-1, "El 16 de septiembre de 1810 [1] y en 1821, 25 % más.", "Inició el 16 de septiembre de 1810. Subió 25%."), (-2, "Entre 1789-1799 [2].", "De 1789 a 1799."), (-3, "Siglo XIX, siglo V", "el SIGLO  XIX"),
    (-4, "9 de septiembre", "19 de septiembre"), (-5, "Sin cifras", "nada"), (-6, "3,5 y 3,5 y 7", "3,5"), (-7, "12–15", "12-15 y 12"),
]


def _answers(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    said = turns.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", F.col("text").alias("answer"))
    held = turns.where("role <> 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("source"))
    own = said.join(held, "conv_id", "left").select("answer_id", "answer", F.coalesce("source", F.lit("")).alias("source"))
    return own.unionByName(literal(spark, _CLAIMED, "answer_id long, answer string, source string"))


_BARE = "regexp_replace(answer, '\\[\\d+\\]', '', 'g')"
_ALL = ", ".join(f"regexp_extract_all({_BARE}, '(?i){p}')" for p in temporal.CLAIMS)
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[–—]', '-', 'g'), '\\s*%', '%', 'g'), '\\s+', ' ', 'g'))"
CLAIMS = f"""t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
a AS (SELECT conv_id * 1000 + turn AS answer_id, text AS answer, coalesce((SELECT string_agg(o.text, chr(10) ORDER BY o.turn, o.text) FROM t o WHERE o.conv_id = t.conv_id AND o.role <> 'assistant'), '') AS source FROM t WHERE role = 'assistant'
  UNION ALL SELECT answer_id::BIGINT, answer, source FROM {values(_CLAIMED, "answer_id, answer, source")}),
cl AS (SELECT answer_id, source, unnest(l) AS claim, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT answer_id, source, flatten([{_ALL}]) AS l FROM a)),
cn AS (SELECT *, {_NORM.format("claim")} AS normalized FROM cl)"""


@query(f"WITH {CLAIMS} SELECT answer_id, pos::INTEGER AS pos, claim, normalized FROM cn")
def claims(spark, sf_dir):
    return answers.claims(_answers(spark, sf_dir))


@query(f"""
WITH {CLAIMS} SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY pos)::INTEGER AS position, claim
FROM (SELECT answer_id, normalized, min(pos) AS pos, arg_min(claim, pos) AS claim FROM cn WHERE NOT contains({_NORM.format("source")}, normalized) GROUP BY ALL)
""")
def unsupported_claims(spark, sf_dir):
    return answers.unsupported(_answers(spark, sf_dir))


# --- evaluation: a document holds a benchmark passage, or the question should be refused
_EXPECTED = "expected AS (SELECT q0.qid, max(c.url) AS expected FROM q0 LEFT JOIN corpus c ON contains(c.text, q0.question) AND length(q0.question) >= 40 GROUP BY q0.qid)"


def _cases(spark, sf_dir):
    """A case expects a document that has its passage in full. Documents that share four words in a row with it are compared whole.

    Words 2 to 5 are sure to be whole words of the document only where a sixth follows; shorter passages are looked for in all documents.
    """
    words = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    four = lambda i: F.concat_ws(" ", *(F.get("w", i + k) for k in range(4)))
    asked = questions(spark, sf_dir).where(F.length("question") >= 40).withColumn("w", words(F.col("question")))
    short = bounded(asked.where(F.size("w") < 6).select("qid", "question"), 100_000, "short_passages")
    asked = bounded(asked.where(F.size("w") >= 6).select("qid", "question", four(F.lit(1)).alias("key")), 100_000, "passages")
    texts = corpus(spark, sf_dir)
    grams = texts.select("chunk_id", words(F.col("text")).alias("w")).select("chunk_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 4, F.lit(0))), four)).alias("key"))
    near = grams.join(asked.select("qid", "key"), "key").select("qid", "chunk_id").distinct()
    met = near.join(texts.select("chunk_id", "url", "text"), "chunk_id").join(asked.select("qid", "question"), "qid").where(F.col("text").contains(F.col("question")))
    met = met.select("qid", "url").unionByName(texts.join(short, F.col("text").contains(F.col("question"))).select("qid", "url"))
    met = met.groupBy("qid").agg(F.max("url").alias("expected"))
    return questions(spark, sf_dir).select("qid").join(met, "qid", "left").withColumn("should_answer", F.col("expected").isNotNull())


def _results(spark, sf_dir):
    hits = _found(spark, sf_dir)
    return audit.case_results(_cases(spark, sf_dir), hits, hybrid.gate(questions(spark, sf_dir), hits))


RESULTS = f"""{GATE}, {_EXPECTED}, results AS (SELECT e.qid, expected IS NOT NULL AS should_answer, coalesce(bool_or(contains(b.url, expected)), false) AS url_hit, sufficient
  FROM expected e JOIN gate g ON g.qid = e.qid LEFT JOIN best b ON b.qid = e.qid GROUP BY e.qid, expected, sufficient),
judged AS (SELECT *, CASE WHEN should_answer THEN sufficient AND url_hit ELSE NOT sufficient END AS success FROM results)"""


@query(f"WITH {CORPUS}, {ASKED_TERMS}, {_EXPECTED} SELECT qid, expected, expected IS NOT NULL AS should_answer FROM expected")
def eval_load(spark, sf_dir):
    return _cases(spark, sf_dir)


@query(f"WITH {RESULTS} SELECT qid, should_answer, url_hit, sufficient, success FROM judged")
def eval_recall(spark, sf_dir):
    return _results(spark, sf_dir)


@query(f"""
WITH {RESULTS} SELECT count(*) AS total, count(*) FILTER (success) AS passed, coalesce(count(*) FILTER (should_answer AND success)::DOUBLE / nullif(count(*) FILTER (should_answer), 0), 0) AS retrieval_recall,
  coalesce(count(*) FILTER (NOT should_answer AND success)::DOUBLE / nullif(count(*) FILTER (NOT should_answer), 0), 0) AS refusal_accuracy, coalesce(list(qid ORDER BY qid) FILTER (NOT success), []) AS failures FROM judged
""")
def eval_summary(spark, sf_dir):
    return audit.evaluation(_results(spark, sf_dir))
