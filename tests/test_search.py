import math
import random
import sqlite3

import numpy as np
import pytest

from corpusmill.functions import text as T
from corpusmill.models import EchoGenerator, HashEmbedder
from corpusmill.operators import answers, hybrid, lexical, vectors
from corpusmill.settings import Settings, from_environment

CHUNKS = [
    (1, "u1", "Guerra civil", "Historia", "Inicio", "La etapa de inicio 5 fue larga y dura"),
    (2, "u1", "Guerra", "Historia", "Final", "El final de la etapa"),
    (3, "u2", "Célula", "Biología", "Membrana", "La membrana de la célula tiene dos capas"),
    (4, "u3/ejercicio", "Repaso", "Historia", "Inicio", "Etapa etapa inicio"),
    (5, "u4", "", "", "", ""),
]
FIELDS = "chunk_id long, url string, title string, subject string, heading string, text string"


def chunks(spark):
    return spark.createDataFrame(CHUNKS, FIELDS)


def asked(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "qid long, question string")


def test_all_terms_come_before_some(spark):
    got = lexical.bm25_topk(asked(spark, "etapa inicio 5", "membrana", "zzz"), chunks(spark)).orderBy("qid", "lexical_rank").collect()
    assert [r.chunk_id for r in got if r.qid == 0] == [1, 4, 2]
    assert [r.chunk_id for r in got if r.qid == 1] == [3] and not [r for r in got if r.qid == 2]


def test_scores_match_the_full_text_index_of_sqlite(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, title, subject, heading, text, tokenize = 'unicode61 remove_diacritics 2')")
    many = [(100 + i, f"v{i}", f"Tema {i % 7}", "S", f"parte {i % 3}", " ".join(f"palabra{(i * k) % 11}" for k in range(i % 13))) for i in range(60)]
    rows = [*CHUNKS, *many]
    db.executemany("INSERT INTO f VALUES (?, ?, ?, ?, ?, ?)".replace("?, ?, ?, ?, ?, ?", "?, ?, ?, ?, ?"), [(i, *r) for i, _, *r in rows])
    question = "etapa palabra3 tema palabra7"
    want = dict(db.execute("SELECT id, -bm25(f, 0.0, 2.0, 1.0, 1.5, 1.0) FROM f WHERE f MATCH ?", (" OR ".join(f'"{t}"' for t in question.split()),)).fetchall())
    got = {r.chunk_id: r.bm25 for r in lexical.bm25_topk(asked(spark, question), spark.createDataFrame(rows, FIELDS), 1000).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-11) for k in want)


def test_semantic_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 17)
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(60, 8)).astype(np.float32), rng.normal(size=(5, 8)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (98, [0.0] * 8)]
    got = vectors.semantic_topk(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, vector array<float>"), spark.createDataFrame(rows, "chunk_id long, vector array<float>"), 7).collect()
    a, b = (x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True) for x in (q, v))
    for i, sims in enumerate(a @ b.T):
        own = [r.chunk_id for r in sorted((r for r in got if r.qid == i), key=lambda r: r.semantic_rank)]
        assert own == np.argsort(-sims)[:7].tolist()


def test_pending_is_null_safe(spark):
    rows = spark.createDataFrame([("u", 0, [1.0], "m"), ("u", 1, None, None), ("u", 2, [1.0], "old"), ("u", 3, [1.0], None), ("gone", 0, None, None)], "url string, ordinal int, embedding array<float>, embedding_model string")
    docs = spark.createDataFrame([("u", "t", "s", True), ("gone", "t", "s", False)], "url string, title string, subject string, active boolean")
    assert sorted(r.ordinal for r in vectors.pending(rows, docs, "m").collect()) == [1, 2, 3]
    assert [r.ordinal for r in vectors.scan(rows, docs, "m").collect()] == [0]


def test_embedder_is_called_in_batches(spark):
    rows = vectors.embed(spark.createDataFrame([(i, f"texto {i}") for i in range(30)], "i int, t string"), "t", HashEmbedder(4), 8).collect()
    assert all(r.vector == pytest.approx(HashEmbedder(4).embed([r.t])[0]) for r in rows)


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid long, chunk_id long, rank int, title string, subject string, heading string, text string, url string, sim double, lexical_rank int")


def test_fusion_rerank_and_cap(spark):
    sem = spark.createDataFrame([(0, 3, 0.9, 1), (0, 1, 0.8, 2), (0, 2, 0.7, 3)], "qid long, chunk_id long, sim double, semantic_rank int")
    lex = spark.createDataFrame([(0, 4, 1), (0, 1, 2), (0, 77, 3)], "qid long, chunk_id long, lexical_rank int")
    fused = {r.chunk_id: r.rrf for r in hybrid.fuse(sem, lex).collect()}
    assert fused[1] == pytest.approx(1.2 / 62 + 1 / 62) and fused[4] == pytest.approx(1 / 61) and fused[77] == pytest.approx(1 / 63)
    got = hybrid.search(asked(spark, "¿Cuándo?"), chunks(spark), sem, lex, 4).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [1, 3, 2, 4]
    assert got[3].score == pytest.approx(0.65 / 61)
    capped = hybrid.best(hybrid.rerank(hybrid.fuse(sem, lex), asked(spark, "x"), chunks(spark)), 5, per_url=1)
    assert [r.url for r in capped.collect()].count("u1") == 1


def test_gate(spark):
    base = ("T", "S", "H")
    rows = [
        (0, 1, 1, *base, "nada", "u", 0.5, None), (1, 1, 1, *base, "nada", "u", 0.3, 5), (2, 1, 1, *base, "nada", "u", 0.3, 6), (3, 1, 1, *base, "en 1821", "u", 0.5, 1), (4, 1, 1, *base, "en 1821", "u", 0.5, 1),
        (5, 1, 1, *base, "16 de septiembre de 1810", "u", 0.5, 1), (6, 1, 1, *base, "nada", "u", None, 1),
    ]
    q = asked(spark, "¿qué es?", "¿qué es?", "¿qué es?", "¿cuándo fue?", "¿qué fecha fue?", "¿qué fecha fue?", "¿qué es?", "sin resultados")
    assert [r.sufficient for r in hybrid.gate(q, hits(spark, rows)).orderBy("qid").collect()] == [True, True, False, True, False, True, False, False]


def test_prompt_and_sources(spark):
    site = Settings().site
    rows = [(0, 1, 1, "A", "S", "H1", "x" * 700, f"https://{site}/alumno/a", 0.5, 1), (0, 2, 2, "B", "S", "H2", "dos", "https://z/b", 0.5, 1), (0, 3, 3, "A", "S", "H3", "tres", f"https://{site}/alumno/a", 0.5, 1)]
    text = answers.prompt_context(hits(spark, rows), asked(spark, "¿qué?")).first().prompt
    assert text.count("<FUENTE 1>") == 2 and text.count("<FUENTE 2>") == 1 and "x" * 650 in text and "x" * 651 not in text and text.endswith("Pregunta: ¿qué?")
    got = answers.sources_list(hits(spark, rows), Settings()).orderBy("position").collect()
    assert [(r.heading, r.url) for r in got] == [("H1", f"https://{Settings().mirror}/alumno/a"), ("H2", "https://z/b")]


CLAIMS = [
    (0, "El 16 de septiembre de 1810 [1].", "Inició el 16 de septiembre de 1810.", []), (1, "El 15 de septiembre de 1810.", "Inició el 16 de septiembre de 1810.", ["15 de septiembre de 1810", "15"]),
    (2, "De 1789-1799.", "De 1789 a 1799.", ["1789-1799"]), (3, "25 % y 25%", "un 25%", []), (4, "9 de septiembre", "19 de septiembre", []), (5, "7 y 7", "", ["7"]), (6, "sin cifras", "", []),
]


def test_unsupported_claims(spark):
    frame = spark.createDataFrame([c[:3] for c in CLAIMS], "answer_id long, answer string, source string")
    got = {}
    for r in answers.unsupported(frame).orderBy("answer_id", "position").collect():
        got.setdefault(r.answer_id, []).append(r.claim)
    assert {i: got.get(i, []) for i, *_ in CLAIMS} == {i: want for i, _, _, want in CLAIMS}
    assert [r.claim for r in answers.unsupported(frame, strict=True).where("answer_id = 4").collect()] == ["9 de septiembre", "9"]


class Liar(EchoGenerator):
    def answer(self, messages):
        yield "Fue en 1492."


@pytest.mark.parametrize(("generator", "refused"), [(EchoGenerator(), False), (Liar(), True)])
def test_chat_events(spark, generator, refused):
    import json

    q = asked(spark, "¿qué es?", "¿otra?")
    rows = hits(spark, [(0, 1, 1, "A", "S", "H", "texto", "u", 0.9, 1)])
    got = [json.loads(r.event) for r in answers.chat(q, rows, hybrid.gate(q, rows), generator, Settings()).orderBy("qid", "seq").collect()]
    assert [e["type"] for e in got] == ["sources", "token", "done"] * 2
    assert [e["refused"] for e in got if e["type"] == "done"] == [refused, True]
    assert got[0]["sources"][0]["url"] == "u" and got[3]["sources"] == []


def test_settings():
    got = from_environment({"CORPUSMILL_MAX_PAGES": "0", "CORPUSMILL_INDEX_ALL": "Yes", "CORPUSMILL_DELAY_SECONDS": "-1", "CORPUSMILL_SUBJECT": "x"})
    assert (got.max_pages, got.index_all, got.delay_seconds, got.subject) == (1, True, 0.0, "x")
    assert from_environment({}) == Settings()


def test_stop_words_are_distinct():
    assert len(T.STOPWORDS) == len(set(T.STOPWORDS)) == 32


def test_cases_of_passages_with_few_words(spark, monkeypatch):
    from corpusmill.plans import search

    asked = ["日本語" * 20, "http://example.org/" + "a" * 40, "alpha bravoooooooooo charlieeeeeeeee deltaaaaa echo", "one two three four five six seven eight nine ten", "not there " * 5]
    texts = [f"vor {asked[0]}nach", f"see {asked[1]}/x", f"so {asked[2]}es, and more", f"zero {asked[3]}s"]
    questions = spark.createDataFrame(list(enumerate(asked)), "qid long, question string")
    corpus = spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(texts)], "chunk_id long, url string, text string")
    monkeypatch.setattr(search, "questions", lambda *_: questions)
    monkeypatch.setattr(search, "corpus", lambda *_: corpus)
    got = {r.qid: (r.expected, r.should_answer) for r in search._cases(spark, "").collect()}
    assert got == {i: (f"u{i}", True) for i in range(4)} | {4: (None, False)}


def test_scores_do_not_depend_on_the_order_of_summation(spark):
    """Equal parts in another order are equal scores: copies tie, and go by chunk_id."""
    words = [f"w{i:02d}" for i in range(12)]
    counts = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]
    rows = [(i, words[j], counts[(i + j) % 12]) for i in range(600) for j in range(12)]
    index = lexical.Index(spark.createDataFrame([(i, w, 1, float(c), 60) for i, w, c in rows], "chunk_id long, term string, tf long, wf double, length long"), spark.createDataFrame([(6000, 301072)], "chunks long, tokens long"))
    got = lexical.search(index, asked(spark, " ".join(words)), 600).orderBy("lexical_rank").collect()
    assert len({r.bm25 for r in got}) == 1 and [r.chunk_id for r in got] == list(range(600))


def test_postings_are_counted_within_rows(spark):
    rows = [(7, "u", "Área e\u0301l", "s", None, "el ÁREA 12 \u0301 area\u0301x"), (8, None, None, None, None, " \u0301 "), (9, "", "", "", "", "")]
    made = lexical.postings(spark.createDataFrame(rows, FIELDS))
    assert sorted(map(tuple, made.collect())) == [("12", 7, 1, 1.0, 7), ("area", 7, 2, 3.0, 7), ("areax", 7, 1, 1.0, 7), ("el", 7, 2, 3.0, 7), ("s", 7, 1, 1.0, 7)]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_texts_that_were_not_hit_are_not_shuffled(spark, monkeypatch):
    from corpusmill.plans import search

    plans, write = {}, search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(df, name))
    assert search._reranked(spark, "/root/testdata/sf0.001").count() > 0
    assert "BroadcastHashJoin" in plans["hit"] and "hashpartitioning" not in plans["hit"]


def test_fusion_ranks_equal_parts_by_chunk(spark):
    """Equal parts in another order are equal scores, so the ranks that fusion takes follow chunk_id."""
    words, counts = [f"w{i:02d}" for i in range(12)], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]
    rows = [(i, words[j], 1, float(counts[(i + j) % 12]), 60) for i in range(600) for j in range(12)]
    index = lexical.Index(spark.createDataFrame(rows, "chunk_id long, term string, tf long, wf double, length long"), spark.createDataFrame([(6000, 301072)], "chunks long, tokens long"))
    none = spark.createDataFrame([], "qid long, chunk_id long, sim double, semantic_rank int")
    got = hybrid.fuse(none, lexical.search(index, asked(spark, " ".join(words)), 600)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.lexical_rank) for r in got] == [(i, i + 1) for i in range(600)]


def test_chat_events_shuffle_no_texts(spark, tmp_path):
    """Of a corpus that the questions hardly hit, neither texts nor tokens are shuffled, also where the index is built first."""
    from corpusmill.plans import search

    rng = random.Random(3)
    texts = ["alfa beta gamma delta epsilon", *(" ".join(f"{rng.getrandbits(64):016x}" for _ in range(600)) for _ in range(600))]
    spark.createDataFrame([(i, t, "es", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alfa beta gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(2)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = shuffled()
    assert search.chat_events(spark, str(tmp_path)).where("qid = 0").count() == 3
    assert 0 < shuffled() - before < sum(map(len, texts)) / 20


def test_sums_of_pairs_hold_no_more_than_they_need(spark):
    """The number of a question's terms joins its sums after they are shuffled, and either way of the search gives the same rows."""
    index, q = lexical.build(chunks(spark)), asked(spark, "etapa inicio 5", "membrana célula", "zzz", "guerra civil etapa")
    one, other = lexical.search(index, q), lexical.search(index, q, most_rows=0)
    sums = [line for line in one._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate(keys=[qid" in line and "chunk_id" in line.split("functions")[0]]
    assert sums and not any("n_terms" in line for line in sums)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.select(one.columns).collect())) and one.count() > 0
    assert one.columns == ["qid", "chunk_id", "matched", "n_terms", "bm25", "lexical_rank"]
